"""Settings with types: a value that doesn't fit its default's type is the default; raw texts are read by kind."""

from __future__ import annotations

from typing import Any

TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off", ""}


def fits(value: Any, default: Any) -> bool:
    if default is None:
        return True
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(value, bool) and isinstance(default, bool)
    if isinstance(default, float):
        return isinstance(value, (int, float))
    return isinstance(value, type(default))


class Settings:
    def __init__(self, values: dict[str, Any] | None = None):
        self._values = dict(values or {})

    def get(self, key: str, default: Any = None) -> Any:
        value = self._values.get(key, default)
        return value if fits(value, default) else default

    def set(self, key: str, value: Any) -> None:
        self._values[key] = value

    def unset(self, key: str) -> None:
        self._values.pop(key, None)

    def all(self) -> dict[str, Any]:
        return dict(self._values)


def coerce(kind: str, raw: Any, choices: list | None = None, least: float | None = None, most: float | None = None) -> Any:
    """raw (often a text) as bool, int, float, list or text; ValueError if it can't be, isn't a choice or is out of range."""
    text = raw.strip() if isinstance(raw, str) else raw
    if kind == "bool":
        low = str(text).lower()
        if low not in TRUE | FALSE:
            raise ValueError(f"{raw!r} is neither on nor off")
        value: Any = low in TRUE
    elif kind in ("int", "float"):
        if isinstance(text, bool):
            raise ValueError(f"{raw!r} is no number")
        value = float(text)
        if kind == "int":
            if value != int(value):
                raise ValueError(f"{raw!r} is no whole number")
            value = int(value)
    elif kind == "list":
        value = [x.strip() for x in (text.replace("\n", ",").split(",") if isinstance(text, str) else map(str, text)) if x.strip()]
    else:
        value = str(text)
    if choices is not None and value not in choices:
        raise ValueError(f"{value!r} is none of {choices}")
    if isinstance(value, (int, float)) and ((least is not None and value < least) or (most is not None and value > most)):
        raise ValueError(f"{value!r} is out of range")
    return value


def shown(kind: str, value: Any) -> str:
    if value is None:
        return ""
    return ", ".join(map(str, value)) if kind == "list" else ("on" if value else "off") if kind == "bool" else str(value)
