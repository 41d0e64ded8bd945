"""Options: strings by case-folded name, parsed when they are first asked for."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Mapping
from typing import Any

from weftline.functions import units

# Options with their defaults.
DEFAULTS = {
    "log": "WARN",
    "statistics": "False",
    "num_streams": "16",
    "num_streaming_threads": "1",
    "spill_device_limit": "80%",
    "periodic_spill_check": "1ms",
    "memory_reserve_timeout": "100 ms",
    "allow_overbooking_by_default": "true",
    "pinned_memory": "false",
    "pinned_initial_pool_size": "0%",
    "pinned_max_pool_size": "80%",
    "ucxx_progress_mode": "thread-blocking",
}
MAGIC, MOST_OPTIONS, MOST_BYTES = b"WFOP", 65_536, 1 << 20


def text_bool(text: str) -> bool:
    number = re.match(r"\s*([+-]?\d+)", text)
    word = text.strip().lower()
    if number:
        return int(number[1]) != 0
    if word in units.TRUE_WORDS:
        return True
    if word in units.FALSE_WORDS:
        return False
    raise ValueError(f"not a boolean: {text!r}")


def text_nbytes(text: str) -> int:
    found = re.fullmatch(r"\s*" + units.NUMBER + r"\s*([A-Za-z]*)\s*", text)
    unit = found[2].upper() if found else "?"
    if unit in ("", "B"):
        factor = 1
    elif len(unit) in (2, 3) and unit[0] in units.POWERS and unit[1:] in ("B", "IB"):
        factor = (1000 if unit[1:] == "B" else 1024) ** units.POWERS[unit[0]]
    else:
        raise ValueError(f"not a byte size: {text!r}")
    value = float(found[1]) * factor
    return int(abs(value) + 0.5) * (-1 if value < 0 else 1)


def text_duration(text: str) -> float:
    found = re.fullmatch(r"\s*" + units.NUMBER + r"\s*([A-Za-zµ]*)\s*", text)
    if not found or found[2] not in ("", *units.DURATION_UNITS):
        raise ValueError(f"not a duration: {text!r}")
    return float(found[1]) * units.DURATION_UNITS.get(found[2], 1.0)


def text_optional(text: str) -> str | None:
    return None if text.strip().lower() in units.DISABLED_WORDS else text


PARSERS: dict[type, Callable[[str], Any]] = {bool: text_bool, int: int, float: float, str: str}


class Options:
    """First insertion wins; a value's type is fixed by the first typed access."""

    def __init__(self, values: Mapping[str, str] | None = None):
        self._texts: dict[str, str] = {}
        self._typed: dict[str, Any] = {}
        for name, text in (values or {}).items():
            self.insert_if_absent(name, text)

    def insert_if_absent(self, name: str, text: str) -> bool:
        key = name.strip().lower()
        if key in self._texts:
            return False
        self._texts[key] = str(text)
        return True

    def get(self, name: str, kind: type = str, parse: Callable[[str], Any] | None = None, default: str | None = None) -> Any:
        """Names are looked up as given: only insertion folds case."""
        if name in self._typed:
            value = self._typed[name]
            if not isinstance(value, kind) and value is not None:
                raise ValueError(f"option {name!r} was read as {type(value).__name__}, not {kind.__name__}")
            return value
        text = self._texts.get(name, DEFAULTS.get(name) if default is None else default)
        if text is None:
            raise KeyError(name)
        self._typed[name] = value = (parse or PARSERS[kind])(text)
        return value

    def strings(self) -> dict[str, str]:
        return dict(self._texts)

    def serialize(self) -> bytes:
        if self._typed:
            raise ValueError("options can't be serialized after typed access")
        if len(self._texts) > MOST_OPTIONS:
            raise ValueError("too many options")
        body = b""
        for name, text in sorted(self._texts.items()):
            for part in (name.encode(), text.encode()):
                if len(part) > MOST_BYTES:
                    raise ValueError("an option is too long")
                body += struct.pack("<I", len(part)) + part
        return MAGIC + struct.pack("<II", len(self._texts), zlib.crc32(body)) + body

    @classmethod
    def deserialize(cls, data: bytes) -> Options:
        if data[:4] != MAGIC or len(data) < 12:
            raise ValueError("not serialized options")
        n, checksum = struct.unpack_from("<II", data, 4)
        body, at, parts = data[12:], 0, []
        if zlib.crc32(body) != checksum:
            raise ValueError("serialized options are damaged")
        while at < len(body):
            (size,) = struct.unpack_from("<I", body, at)
            parts.append(body[at + 4 : at + 4 + size].decode())
            at += 4 + size
        if len(parts) != 2 * n:
            raise ValueError("serialized options are damaged")
        return cls(dict(zip(parts[::2], parts[1::2], strict=True)))

    def session_conf(self) -> dict[str, str]:
        """Spark settings that options stand for."""
        out = {}
        if "num_streaming_threads" in self._texts:
            out["spark.task.cpus"] = self._texts["num_streaming_threads"]
        if "log" in self._texts:
            out["spark.log.level"] = {"TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "WARN": "WARN"}.get(self._texts["log"].upper(), "ERROR")
        return out


def from_environment(pattern: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Variables whose whole name matches ``pattern``, by what its one capture group holds."""
    compiled = re.compile(pattern)
    if compiled.groups != 1:
        raise ValueError("the pattern needs exactly one capture group")
    source = os.environ if environment is None else environment
    return {m[1]: v for k, v in source.items() if (m := compiled.fullmatch(k))}
