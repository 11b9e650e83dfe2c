"""Unit strings: segmentation by dynamic programming over tries of prefixes, roots and exponents."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

# Dimensions are exponents of (length, mass, time, temperature). A turn counts as the number 1.
_L, _M, _T, _K = (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)
_FORCE, _NONE, _FREQ = (1, 1, -2, 0), (0, 0, 0, 0), (0, 0, -1, 0)
_PRESSURE, _POWER, _TORQUE = (-1, 1, -2, 0), (2, 1, -3, 0), (2, 1, -2, 0)

#: name of the quantity: (dimension, factor of the common unit to SI, common unit, usual values in the common unit)
QUANTITIES: dict[str, tuple[tuple[int, ...], float, str, tuple[float, float]]] = {
    "speed": (_FREQ, 1 / 60, "rpm", (300, 15000)),
    "torque": (_TORQUE, 1.0, "Nm", (0.2, 400)),
    "temperature": (_K, 1.0, "°C", (5, 1100)),
    "pressure": (_PRESSURE, 1e5, "bar", (0.2, 60)),
    "power": (_POWER, 1e3, "kW", (1, 200)),
    "length": (_L, 1e-3, "mm", (0.005, 2000)),
    "mass": (_M, 1.0, "kg", (0.01, 500)),
}
_BY_DIM = {q[0]: name for name, q in QUANTITIES.items()}

# SI prefixes that measured quantities use.
_PREFIXES = {"k": 1e3, "M": 1e6, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "μ": 1e-6, "u": 1e-6, "n": 1e-9}

# Unit roots as (dimension, factor to SI, offset to SI, takes prefixes, cost of this reading).
_G0 = 9.80665
_ROOTS: list[tuple[str, tuple[int, ...], float, float, bool, float]] = [
    *((s, _L, 1.0, 0.0, True, 0.0) for s in ("m", "meter", "metre", "Meter", "mètre", "metro")),
    *((s, _L, 0.0254, 0.0, False, 0.0) for s in ("in", "inch", "inches", "Zoll", "pouce", '"')),
    *((s, _L, 0.3048, 0.0, False, 0.0) for s in ("ft", "foot", "feet")),
    *((s, _L, 2.54e-5, 0.0, False, 0.0) for s in ("thou", "mil")),
    *((s, _M, 1e-3, 0.0, True, 0.0) for s in ("g", "gr", "gramm", "Gramm", "gram")),
    *((s, _M, 0.45359237, 0.0, False, 0.0) for s in ("lb", "lbs", "lbm", "pound", "pounds")),
    *((s, _M, 0.45359237 / 16, 0.0, False, 0.0) for s in ("oz", "ozm", "ounce", "ounces")),
    ("t", _M, 1e3, 0.0, False, 0.6),
    *((s, _T, 1.0, 0.0, True, 0.0) for s in ("s", "sec", "Sek")),
    *((s, _T, 60.0, 0.0, False, 0.0) for s in ("min", "Min", "mn", "minute")),
    *((s, _T, 3600.0, 0.0, False, 0.1) for s in ("h", "Std")),
    *((s, _FORCE, 1.0, 0.0, True, 0.0) for s in ("N", "Newton", "newton")),
    *((s, _FORCE, _G0, 0.0, False, 0.0) for s in ("kp", "kgf", "kilopond")),
    ("kg", _FORCE, _G0, 0.0, False, 0.8),  # weight for force, as in mkg
    ("p", _FORCE, _G0 / 1e3, 0.0, False, 0.8),
    *((s, _FORCE, 4.4482216152605, 0.0, False, c) for s, c in (("lbf", 0.0), ("lb", 0.8), ("lbs", 0.8))),
    *((s, _FORCE, 4.4482216152605 / 16, 0.0, False, c) for s, c in (("ozf", 0.0), ("oz", 0.8))),
    ("J", _TORQUE, 1.0, 0.0, True, 0.6),
    ("bar", _PRESSURE, 1e5, 0.0, True, 0.0),
    ("Pa", _PRESSURE, 1.0, 0.0, True, 0.0),
    *((s, _PRESSURE, 6894.757293168, 0.0, False, 0.0) for s in ("psi", "PSI")),
    ("atm", _PRESSURE, 101325.0, 0.0, False, 0.0),
    ("at", _PRESSURE, 98066.5, 0.0, False, 0.3),
    *((s, _PRESSURE, 133.322387415, 0.0, False, 0.0) for s in ("mmHg", "Torr")),
    *((s, _POWER, 1.0, 0.0, True, 0.0) for s in ("W", "Watt", "watt")),
    *((s, _POWER, 745.69987158227, 0.0, False, 0.0) for s in ("hp", "HP", "bhp", "BHP")),
    *((s, _POWER, 735.49875, 0.0, False, 0.0) for s in ("PS", "ch", "cv", "CV", "pk")),
    *((s, _K, 1.0, 0.0, False, 0.0) for s in ("K", "Kelvin", "kelvin", "°K", "deg K", "degK")),
    *((s, _K, 1.0, 273.15, False, 0.0) for s in ("°C", "C", "celsius", "Celsius", "deg C", "degC", "° C", "Grad Celsius", "Grad C", "degrees C", "grad C", "grados C", "℃", "ºC")),
    *((s, _K, 5 / 9, 459.67 * 5 / 9, False, 0.0) for s in ("°F", "F", "fahrenheit", "Fahrenheit", "deg F", "degF", "° F", "Grad F", "Grad Fahrenheit", "degrees F", "℉", "ºF")),
    *((s, _FREQ, 1 / 60, 0.0, True, 0.0) for s in ("rpm", "RPM", "upm", "Upm")),
    *((s, _FREQ, 1.0, 0.0, False, 0.0) for s in ("rps",)),
    *((s, _FREQ, 1.0, 0.0, True, 0.0) for s in ("Hz", "hertz", "Hertz")),
    *((s, _NONE, 1.0, 0.0, False, 0.2) for s in ("U", "Umdr", "tr", "tours", "rev", "r", "giri", "g", "vueltas", "rot")),
    *((s, _NONE, 1 / (2 * math.pi), 0.0, True, 0.0) for s in ("rad",)),
    *((s, _NONE, 1 / 360, 0.0, False, 0.3) for s in ("deg", "°")),
]
# Exponents as they are written.
_EXPONENTS = {"": 1, "-1": -1, "^-1": -1, "⁻¹": -1, "-2": -2, "^-2": -2, "⁻²": -2, "^2": 2, "²": 2, "2": 2, "^3": 3, "³": 3, "3": 3}
_SEPARATORS = " ·.*×∙⋅_-"


class Trie:
    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.values: list = []

    def add(self, key: str, value) -> None:
        node = self
        for c in key:
            node = node.next.setdefault(c, Trie())
        node.values.append(value)

    def matches(self, text: str, at: int):
        """(end, value) for every key that starts at ``at``."""
        node: Trie | None = self
        while node is not None:
            for v in node.values:
                yield at, v
            if at >= len(text):
                return
            node, at = node.next.get(text[at]), at + 1


_PREFIX_TRIE, _ROOT_TRIE, _EXP_TRIE = Trie(), Trie(), Trie()
for _p, _f in _PREFIXES.items():
    _PREFIX_TRIE.add(_p, _f)
for _name, *_rest in _ROOTS:
    _ROOT_TRIE.add(_name, tuple(_rest))
for _e, _n in _EXPONENTS.items():
    _EXP_TRIE.add(_e, _n)


@dataclass(frozen=True)
class Unit:
    """A value v recorded in the unit is (v * factor + offset) in the common unit of ``quantity``."""

    quantity: str
    factor: float
    offset: float

    @property
    def common(self) -> bool:
        return abs(self.factor - 1) < 1e-6 and abs(self.offset) < 1e-9


def _tokens(text: str, at: int):
    """(end, dimension, factor, offset, cost) of one prefixed and raised unit, or a plain number, at ``at``."""
    for end, (dim, factor, offset, _, cost) in _ROOT_TRIE.matches(text, at):
        yield end, dim, factor, offset, cost + 1
    for mid, scale in _PREFIX_TRIE.matches(text, at):
        for end, (dim, factor, offset, takes, cost) in _ROOT_TRIE.matches(text, mid):
            if takes:
                yield end, dim, factor * scale, offset, cost + 1.3
    if (m := re.compile(r"\d+(?:\.\d+)?").match(text, at)) and float(m[0]) > 0:
        yield m.end(), _NONE, float(m[0]), 0.0, 0.7


@lru_cache(maxsize=50_000)
def parse_unit(text: str | None, prior: str | None = None) -> Unit | None:
    """The cheapest segmentation of a unit string that is one of the quantities; ``prior`` is the quantity that the
    field holds, and readings of another dimension cost more. None if there is no such segmentation.

    Dynamic programming from the end: for each position the cheapest rest by dimension. A slash divides by what
    follows it up to the next slash; other separators multiply, and a hyphen may also start an exponent."""
    if text is None:
        return None
    text = re.sub(r"\s+", " ", text.strip().strip("[]()")).strip()
    if not text:
        return None
    text = re.sub(r"^(\d+)\s*/\s*(\d+)\s+", lambda m: f"{int(m[1]) / max(1, int(m[2])):.9f} ", text)  # as in 1/100 mm
    got = _segment(text, prior) or _segment(_usual_case(text), prior)
    return got[0] if got else None


def _usual_case(text: str) -> str:
    """Spellings in another case, such as NM, KW or RPM."""
    known = {"nm": "Nm", "kw": "kW", "rpm": "rpm", "bar": "bar", "mm": "mm", "kg": "kg", "u/min": "U/min", "°c": "°C", "°f": "°F", "kelvin": "K", "psi": "psi", "hz": "Hz", "ps": "PS", "kpa": "kPa", "mpa": "MPa", "hpa": "hPa"}
    return known.get(text.lower().replace(" ", ""), text.lower())


def _segment(text: str, prior: str | None) -> tuple[Unit, float] | None:
    best: list[dict[tuple, tuple[float, float, float, int]]] = [{} for _ in range(len(text) + 1)]
    best[len(text)][(_NONE, 1)] = (0.0, 1.0, 0.0, 0)
    best[len(text)][(_NONE, -1)] = (0.0, 1.0, 0.0, 0)
    for at in range(len(text) - 1, -1, -1):
        for end, dim, factor, offset, cost in _tokens(text, at):
            for stop, power in _EXP_TRIE.matches(text, end):
                for after, turn, gap in _gaps(text, stop):
                    for sign in (1, -1):
                        for (rest_dim, rest_sign), (rest_cost, rest_factor, rest_offset, n) in best[after].items():
                            if rest_sign != (-1 if turn else sign):
                                continue
                            if n and (offset or rest_offset):
                                continue  # degrees stand alone
                            d = tuple(a + sign * power * b for a, b in zip(rest_dim, dim))
                            c = cost + rest_cost + gap + (0.2 if power != 1 else 0)
                            key = (d, sign)
                            if key not in best[at] or c < best[at][key][0]:
                                best[at][key] = (c, rest_factor * factor ** (sign * power), rest_offset or offset, n + 1)
    found = None
    for (dim, sign), (cost, factor, offset, _) in best[0].items():
        name = _BY_DIM.get(dim)
        if sign != 1 or name is None:
            continue
        cost += 0 if prior in (None, name) else 5
        if found is None or cost < found[1]:
            _, common, _, _ = QUANTITIES[name]
            shift = (offset - 273.15) if name == "temperature" else 0.0
            found = Unit(name, factor / common, shift / common), cost
    return found


def _gaps(text: str, at: int):
    """(position of the next unit, whether a slash stands before it, cost) after a unit that ends at ``at``."""
    if at == len(text):
        yield at, False, 0.0
        return
    yield at, False, 0.3  # nothing between, as in Nm
    m = re.compile(r" ?/ ?").match(text, at)
    if m:
        yield m.end(), True, 0.0
    if text[at] in _SEPARATORS:
        yield at + 1, False, 0.1
        if text[at + 1 : at + 2] == " ":
            yield at + 2, False, 0.1


#: words before a number that leave it a number
_QUALIFIER = r"(?:approx\.?|about|ca\.?|circa|env\.?|environ|etwa|rund|max\.?|min\.?|aprox\.?|[~≈<>≤≥±=])"
CELL_PATTERN = rf"(?i)^\s*({_QUALIFIER}\s*)*([-+−]?(?:\d{{1,3}}(?:[ '’  ]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*)(?:[eE][-+]?\d+)?)(?![\d:])\s*(.*?)\s*$"
_CELL = re.compile(CELL_PATTERN)


def numbers_of(written: str) -> list[float]:
    """The values a written number can have, the likelier reading first: 1.234,5 and 1,234.5 have one, 1,234 has two."""
    s = re.sub(r"[ '’  ]", "", written).replace("−", "-")
    dots, commas = s.count("."), s.count(",")
    if dots and commas:
        dec = "." if s.rfind(".") > s.rfind(",") else ","
        return [float(s.replace("," if dec == "." else ".", "").replace(dec, "."))]
    if dots + commas > 1:
        return [float(s.replace(".", "").replace(",", ""))]
    if dots + commas == 1:
        head, tail = re.split(r"[.,]", s)
        dec = float(f"{head}.{tail}")
        if re.fullmatch(r"\d{3}", tail) and re.fullmatch(r"[-+]?[1-9]\d{0,2}", head):
            return [dec, float(head + tail)]
        return [dec]
    return [float(s)]


def pick_number(written: str, quantity: str, factor: float, offset: float) -> float:
    """The reading of ``written`` whose value in the common unit is nearest to the quantity's usual values."""
    both = numbers_of(written)
    if len(both) == 1:
        return both[0]
    lo, hi = QUANTITIES[quantity][3]

    def away(v: float) -> float:
        x = v * factor + offset
        return 0.0 if lo <= x <= hi else min(abs(math.log(max(abs(x), 1e-9) / max(lo, 1e-3))), abs(math.log(max(abs(x), 1e-9) / hi)))

    return min(both, key=away)


def split_cell(cell: str | None) -> tuple[str, str] | None:
    """(number as written, unit text) of a cell that holds a number, else None."""
    m = _CELL.match(cell) if cell else None
    return (m[2], m[3]) if m else None


# Signs that stand between a name and its unit in headers and remarks.
_HEADER = re.compile(r"[\[(]([^\[\]()]+)[\])]\s*$|\s(?:in|en)\s+(\S.*)$|,\s*(\S.*)$|\s/\s*(\S.*)$|:\s*(\S.*)$")
_REMARK = re.compile(r"[\[(]([^\[\]()]+)[\])]|(?:\b(?:in|en|as|are|is|to|auf|mit|sont|est|son|sono|unit|Einheit)\b|:|=)\s*(.+)$", re.I)


@lru_cache(maxsize=50_000)
def header_unit(header: str | None) -> Unit | None:
    """The unit at the end of a column header: in brackets, or after ``in``, a comma, a slash or a colon."""
    text = (header or "").strip()
    for m in _HEADER.finditer(text):
        got = parse_unit(next(g for g in m.groups() if g))
        if got:
            return got
    return None


@lru_cache(maxsize=50_000)
def remark_units(remark: str | None) -> dict[str, Unit]:
    """Units that a remark gives, by quantity: what stands in brackets or after ``in``, ``as``, ``to``, a colon and
    the like, if it is a unit up to the end of its clause."""
    out: dict[str, Unit] = {}
    for clause in re.split(r"[;\n]|,\s", remark or ""):
        for m in _REMARK.finditer(clause):
            tail = (m[1] or m[2]).strip().rstrip(".")
            words = tail.split(" ")
            for i in range(len(words)):
                got = parse_unit(" ".join(words[i:]))
                if got and (i == 0 or re.fullmatch(r"(?i)(in|en|as|are|to|off|auf)", words[i - 1])):
                    out.setdefault(got.quantity, got)
                    break
    return out
