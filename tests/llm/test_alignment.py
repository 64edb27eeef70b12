"""Alignment of two tokenizers against a plain loop over bytes, tokens and documents."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from lakefind.llm import alignment

SCHEMA = "doc_id long, text string, n_a string, pairs string, row string, id string"


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers as p

    return alignment.ByteLevel(p.path("byte_bpe_50k.json"), p.PATTERN), alignment.Pieces(p.path("piece_bpe_32k.model"))


def by_hand(rows):
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    assert len(letters) == 256 and letters["Ġ"] == 32 and letters["Ċ"] == 10 and letters["é"] == 0xE9
    docs = []
    for i, t in rows:
        spans = []
        if t:
            a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
            spell_a = [bytes(letters[c] for c in a_tok.id_to_token(x)) for x in a]
            spell_b = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(spell_a) == b"".join(spell_b) == (" " + t).encode():
                for ids, spelt in ((a, spell_a), (b, spell_b)):
                    at, out = 0, []
                    for x, s in zip(ids, spelt, strict=True):
                        out.append((x, at, at + len(s)))
                        at += len(s)
                    spans.append(out)
        docs.append((i, spans))
    linked, count = [], Counter()
    for _, spans in docs:
        links = []
        if spans:
            j = 0
            for x, s, e in spans[0]:
                while spans[1][j][2] <= s:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][1] < e:
                    links.append((x, spans[1][k][0]))
                    k += 1
        linked.append(links)
        count.update(set(links))
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = Counter()
    for (i, spans), links in zip(docs, linked, strict=True):
        text, n_groups = "", 0
        if spans:
            cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            n_groups, at, parts = len(cuts), [0, 0], []
            for c in cuts:
                sides = []
                for k in (0, 1):
                    ids = []
                    while at[k] < len(spans[k]) and spans[k][at[k]][2] <= c:
                        ids.append(str(spans[k][at[k]][0]))
                        at[k] += 1
                    sides.append(",".join(ids))
                parts.append("|".join(sides))
            text = hashlib.sha256(";".join(parts).encode()).hexdigest()
        n = [len(x) for x in spans] or [0, 0]
        out[i, *n, n_groups, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), text] += 1
    return out


def cases():
    r = random.Random(5)
    odd = ["", " ", "a", "<s> </s> <unk> <|endoftext|>", "a▁b", "two  spaces\n\n\tand tabs ", "\x00\x01 0x0A <0x0A>", "日本語テキスト и русский", "ﬁ①é́ 💡🏳️‍🌈", "a" * 3000, "　x", "don't I'll 123456 1,000"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + i, "".join(chr(r.choice((r.randrange(32, 127), r.randrange(0xA0, 0x3000)))) for _ in range(r.randint(1, 300)))) for i in range(60)]
    return rows + [(None, None), (None, "again"), (7, "again"), (7, "again"), (8, "word " * 20_000)]


@pytest.mark.parametrize("hot", [0, 50, 1 << 20])
def test_by_hand(spark, pair, hot):
    rows = cases() + [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    d = spark.createDataFrame([(*x, "k", "k", "k", "k") for x in rows], SCHEMA).repartition(3)
    got = Counter((x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in alignment.aligned(d, *pair, hot=hot).collect())
    assert got == by_hand(rows)


def test_empty_table_and_tokenless_rows(spark, pair):
    assert alignment.aligned(spark.createDataFrame([], SCHEMA), *pair).collect() == []
    d = spark.createDataFrame([(1, None), (2, ""), (3, "x▁y")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.aligned(d, *pair).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)}


def test_ranked_merge_gives_the_ids_of_the_file(pair):
    """Every code point beside letters, digits, marks and spaces is split and merged alike."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    a = pair[0]
    assert a.ranked
    encode = a.loaded()
    texts = [f" a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}{chr(c)}  b" for c in range(0, 0x30000, 3) if not 0xD800 <= c < 0xE000]
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [encode(x) for x in texts]
    a.ranked = False
    assert a.loaded()(texts[400]) == encode(texts[400])
    a.ranked = True
