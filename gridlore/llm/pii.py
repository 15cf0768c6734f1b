"""Personal numbers, dates and addresses replaced by keyed permutations of their own format, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

ROUNDS = 8
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_SPACED = "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: What may be personal, in the order in which the alternatives are tried. Whether it is decides the check in _kind.
#: The labels of a domain can be given back, as a full stop may follow; names have at most 127 labels, which bounds Java's recursion.
PATTERNS = {
    "iban": rf"(?<![A-Za-z0-9])(?:{_SPACED}|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}})(?![A-Za-z0-9])",
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}",
    "iso_date": r"(?<![\d-])(?:19|20)\d\d-[01]\d-[0-3]\d(?![\d-])",
    "day_date": r"(?<![\d/])[0-3]\d/[01]\d/(?:19|20)\d\d(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+.-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![.-]?\d)|\+\d{8,15}(?!\d)",
}
#: Digit groups with single separators, 13 digits or more, up to what starts another kind or a decimal: any number of cards and other numbers.
_GROUP = r"\d++(?!\.\d)"
RUN = rf"(?<![\d.])(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -](?!{'|'.join(PATTERNS[k] for k in ('iso_date', 'day_date', 'ssn', 'ip', 'phone'))}){_GROUP})*+"
#: Group sizes of printed cards, tried in this order; before them one unbroken group.
LAYOUTS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 4, 5), (6, 13))
CARD_DIGITS = (13, 19)
#: Steps of a cycle walk, as rounds of rounds. A step fails with about a tenth for each other way to read the unit, so far fewer do; a walk that doesn't end is an error, never a wrong text.
WALK = (16, 64)
KINDS = (*PATTERNS, "card")
ANY = "|".join(f"(?:{p})" for p in (*PATTERNS.values(), RUN))
_PIECES = "array<struct<m:string,kind:string>>"
#: The days from 1900-01-01 to 2099-12-31, which are all that the patterns take, as the product of the halves' sizes.
DATE_SPAN = (17, 4297)
#: Ranges of characters that are all letters, or all digits, of one script (and one case in Latin-1), the first and the last of each. A
#: character moves within its range.
ASCII_RANGES = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
RANGES = (
    (0xC0, 0xD6), (0xE0, 0xF6), (0xD8, 0xDE), (0xF8, 0xFF), (0x100, 0x17F), (0x180, 0x24F), (0x250, 0x2AF), (0x370, 0x373), (0x388, 0x38A), (0x38E, 0x3A1), (0x3A3, 0x3F5), (0x3F7, 0x3FF),
    (0x400, 0x481), (0x48A, 0x523), (0x531, 0x556), (0x561, 0x587), (0x5D0, 0x5EA), (0x621, 0x64A), (0x660, 0x669), (0x671, 0x6D3), (0x6F0, 0x6F9), (0x905, 0x939), (0x966, 0x96F), (0x985, 0x98C), (0x993, 0x9A8), (0x9AA, 0x9B0),
    (0x9E6, 0x9EF), (0xA05, 0xA0A), (0xA13, 0xA28), (0xA85, 0xA8D), (0xA93, 0xAA8), (0xB85, 0xB8A), (0xBAE, 0xBB9), (0xC05, 0xC0C), (0xC12, 0xC28), (0xC85, 0xC8C), (0xC92, 0xCA8), (0xD05, 0xD0C), (0xD12, 0xD28), (0xE01, 0xE30), (0xE50, 0xE59),
    (0xE94, 0xE97), (0xE99, 0xE9F), (0xF49, 0xF6C), (0x1000, 0x102A), (0x10A0, 0x10C5), (0x10D0, 0x10FA), (0x1200, 0x1248), (0x1780, 0x17B3), (0x1820, 0x1877), (0x1E00, 0x1EFF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3105, 0x312D),
    (0x3131, 0x318E), (0x3400, 0x4DB5), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A),
)
MOVABLE = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in (*ASCII_RANGES, *RANGES))
#: Where a run of groups would be cut by a date.
DATED = rf"(?:^|[^\d-])(?:19|20)\d\d-[01]\d-[0-3]\d(?![\d-])"

# All expressions are SQL texts, which Spark parses once; functions of this module put them together. key is a column.

_VARIABLES = count()


def _with(value: str, f: Callable[[str], str]) -> str:
    """f of value, which is computed once."""
    v = f"x{next(_VARIABLES)}"
    return f"transform(array({value}), {v} -> {f(v)})[0]"


def _map(array: str, f: Callable[[str], str]) -> str:
    v = f"x{next(_VARIABLES)}"
    return f"transform({array}, {v} -> {f(v)})"


def _map_at(array: str, f: Callable[[str, str], str]) -> str:
    v, i = f"x{next(_VARIABLES)}", f"x{next(_VARIABLES)}"
    return f"transform({array}, ({v}, {i}) -> {f(v, i)})"


def _fold(array: str, start: str, step: Callable[[str, str], str], end: Callable[[str], str] | None = None) -> str:
    a, v, e = (f"x{next(_VARIABLES)}" for _ in range(3))
    return f"aggregate({array}, {start}, ({a}, {v}) -> {step(a, v)}" + (f", {e} -> {end(e)})" if end else ")")


def _order(inverse: bool) -> str:
    return f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"


def _noise(tweak: str, i: str, other: str) -> str:
    return f"sha2(concat_ws('|', key, '{tweak}', cast({i} as string), {other}), 256)"


def _shift(part: str, noise: str, sign: int, wide: bool) -> str:
    """Each character of a range moved within it by its own share of the noise."""

    def move(digest: str, c: str, j: str) -> str:
        def turned(a: str) -> str:
            by = f"{sign} * cast(conv(substring({digest}, pmod({j}, 16) * 4 + 1, 4), 16, 10) as int)"
            place = lambda low, high: f"({low} + pmod({a} - {low} + {by}, {high - low + 1}))"
            ascii_ = " ".join(f"when {a} between {low} and {high} then char({place(low, high)})" for low, high in ASCII_RANGES)
            if not wide:
                return f"case {ascii_} else {c} end"
            more = " ".join(f"when {a} between {low} and {high} then {place(low, high)}" for low, high in RANGES)
            moved = _with(f"case when {a} > 127 then case {more} end end", lambda n: f"if({n} is null, {c}, decode(unhex(lpad(hex({n}), 4, '0')), 'UTF-16BE'))")
            return f"case {ascii_} else {moved} end"

        return _with(f"ascii({c})", turned)

    return _with(noise, lambda digest: f"array_join({_map_at(f'split({part}, {_q})', lambda c, j: move(digest, c, j))}, '')")


_q = "''"


def permute_text(s: str, tweak: str, inverse: bool = False, wide: bool = False) -> str:
    """A keyed permutation of the strings with characters of the same ranges in the same places: a Feistel network on the two halves."""

    def network(x: str) -> str:
        def step(at: str, i: str) -> str:
            first = f"{i} % 2 = 0"
            new = _shift(f"if({first}, {at}.l, {at}.r)", _noise(tweak, i, f"if({first}, {at}.r, {at}.l)"), -1 if inverse else 1, wide)
            return _with(new, lambda z: f"named_struct('l', if({first}, {z}, {at}.l), 'r', if({first}, {at}.r, {z}))")

        half = f"cast(floor(length({x}) / 2) as int)"
        start = f"named_struct('l', substring({x}, 1, {half}), 'r', substring({x}, {half} + 1, length({x}) - {half}))"
        return _fold(_order(inverse), start, step, lambda at: f"concat({at}.l, {at}.r)")

    return _with(s, network)


def permute_pair(left: str, right: str, a: str | int, b: str | int, tweak: str, inverse: bool = False) -> str:
    """A keyed permutation of the pairs (0 to a-1, 0 to b-1), as a struct l, r; each half is moved modulo its own size."""

    def step(at: str, i: str) -> str:
        first = f"{i} % 2 = 0"
        by = f"{-1 if inverse else 1} * cast(conv(substring({_noise(tweak, i, f'cast(if({first}, {at}.r, {at}.l) as string)')}, 1, 12), 16, 10) as bigint)"
        return _with(by, lambda z: f"named_struct('l', if({first}, pmod({at}.l + {z}, cast({a} as bigint)), {at}.l), 'r', if({first}, {at}.r, pmod({at}.r + {z}, cast({b} as bigint))))")

    return _fold(_order(inverse), f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))", step)


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """The Luhn sum of the digits, the last of which counts once."""
    doubled = lambda v: f"if({v} > 4, {v} * 2 - 9, {v} * 2)"
    each = _map_at(f"split(reverse({digits}), '')", lambda c, i: _with(f"ascii({c}) - 48", lambda v: f"if({i} % 2 = 1, {doubled(v)}, {v})"))
    return _fold(each, "0", lambda t, v: f"{t} + {v}")


def _compact(s: str) -> str:
    return f"replace({s}, ' ', '')"


def _mod97(s: str) -> str:
    """The IBAN remainder of letters and digits, letters counting 10 to 35."""
    codes = _map(f"split({s}, '')", lambda c: _with(f"ascii({c})", lambda a: f"if({a} between 48 and 57, {a} - 48, {a} - 55)"))
    return _fold(codes, "0", lambda t, v: f"if({v} > 9, {t} * 100 + {v}, {t} * 10 + {v}) % 97")


def _into(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    return f"array_join({_map_at(f'split({shape}, {_q})', lambda c, i: f'if(ascii({c}) between 48 and 57, substring({digits}, length({_digits(f"substring({shape}, 1, {i})")}) + 1, 1), {c})')}, '')"


def _day(m: str) -> str:
    return f"if(contains({m}, '-'), try_to_date({m}, 'yyyy-MM-dd'), try_to_date({m}, 'dd/MM/yyyy'))"


def _kind(m: str) -> str:
    """Which kind of personal value m is, after its check: IBAN remainder, an address's movable characters, calendar, allotted number ranges; null if none. Cards: _units."""
    checks = {
        "iban": f"{_mod97(f'concat(substring({_compact(m)}, 5), substring({m}, 1, 4))')} = 1", "email": f"{m} rlike r'^[^@]*[{MOVABLE}]'",
        "iso_date": f"{_day(m)} is not null", "day_date": f"{_day(m)} is not null", "ssn": f"{m} rlike r'^(?!000|666|9)\\d{{3}}-(?!00)\\d{{2}}-(?!0000)\\d{{4}}$'", "ip": "true", "phone": "true",
    }
    return "case " + " ".join(f"when {m} rlike r'^(?:{PATTERNS[kind]})$' and coalesce({ok}, false) then '{kind}'" for kind, ok in checks.items()) + " end"


def _piece(m: str, kind: str) -> str:
    return f"named_struct('m', {m}, 'kind', cast({kind} as string))"


def _split_cards(m: str) -> str:
    """m as units, arrays of pieces: a card in a printed layout, from the left, after the stretch before it; at the end the stretch after the last. A stretch of 13 to 19 digits is a card if it passes Luhn."""
    low, high = CARD_DIGITS
    text = lambda g, i, k: f"array_join(slice({g}, {i} + 1, {k}), '')"
    passes = lambda s: f"{_luhn(_digits(s))} % 10 = 0"

    def chosen(g: str, n: str) -> str:
        """Place and number of groups of each card; n has the groups' digits, 0 for other text."""

        def step(at: str, i: str) -> str:
            layouts = " ".join(f"when slice({n}, {i} + 1, {len(x)}) = array({', '.join(map(str, x))}) and {passes(text(g, i, len(x)))} then {len(x)}" for x in LAYOUTS)
            size = f"case when {n}[{i}] between {low} and {high} and {passes(f'{g}[{i}]')} then 1 {layouts} end"
            took = lambda k: f"if({k} is null, {at}, named_struct('next', {i} + {k}, 'cards', concat({at}.cards, array(named_struct('at', {i}, 'k', {k})))))"
            return f"if({i} < {at}.next, {at}, {_with(size, took)})"

        return _fold(f"sequence(0, size({g}) - 1)", "named_struct('next', 0, 'cards', cast(array() as array<struct<at:int,k:int>>))", step, lambda at: f"{at}.cards")

    def cut(g: str, cards: str) -> str:
        ends, starts = f"concat(array(0), {_map(cards, lambda c: f'{c}.at + {c}.k')})", f"concat({_map(cards, lambda c: f'{c}.at')}, array(size({g})))"
        whole = lambda s: f"if({s} rlike '^[0-9 -]+$' and length({_digits(s)}) between {low} and {high} and {passes(s)}, 'card', null)"
        between = f"zip_with({ends}, {starts}, (e, b) -> {_with(text(g, 'e', 'b - e'), lambda s: _piece(s, whole(s)))})"
        own = f"concat({_map(cards, lambda c: f'array({_piece(text(g, f"{c}.at", f"{c}.k"), "{0}card{0}".format(chr(39)))})')}, array(cast(array() as {_PIECES})))"
        return f"filter(zip_with({between}, {own}, (a, b) -> filter(concat(array(a), b), p -> p.m <> '')), u -> size(u) > 0)"

    size = lambda x: f"if({x} rlike '^[0-9]+[ -]?$', length({_digits(x)}), 0)"
    return _with(f"regexp_extract_all({m}, '[^ -]+[ -]?', 0)", lambda g: _with(_map(g, size), lambda n: _with(chosen(g, n), lambda cards: cut(g, cards))))


def _units(m: str) -> str:
    """A match as units of pieces with their kinds: one piece if it is a value as a whole, else the cards in it and what is between."""
    return _with(_kind(m), lambda kind: f"if({kind} is null and length({_digits(m)}) >= {CARD_DIGITS[0]}, {_split_cards(m)}, array(array({_piece(m, kind)})))")


def _replaced(m: str, kind: str, inverse: bool) -> str:
    """The pseudonym of m: another valid value of the same kind and format; m itself where kind is null."""

    def card(d: str) -> str:
        check = lambda body: _into(m, f"concat({body}, cast(pmod(10 - {_luhn(f'concat({body}, {chr(39)}0{chr(39)})')} % 10, 10) as string))")
        return _with(f"concat(substring({d}, 1, 1), {permute_text(f'substring({d}, 2, length({d}) - 2)', 'card', inverse)})", check)

    def phone(d: str) -> str:
        kept = f"greatest(length({d}) - 10, 0)"
        return _with(f"concat(substring({d}, 1, {kept}), {permute_text(f'substring({d}, {kept} + 1)', 'phone', inverse)})", lambda x: _into(m, x))

    def ip(x: str) -> str:
        """Each part of an address stays among those of as many digits: 0 to 9, 10 to 99, 100 to 255."""
        at, size = lambda i: f"({x}[{i}].v - {x}[{i}].low)", lambda i: f"{x}[{i}].n"
        pair = permute_pair(f"{at(0)} * {size(1)} + {at(1)}", f"{at(2)} * {size(3)} + {at(3)}", f"({size(0)} * {size(1)})", f"({size(2)} * {size(3)})", "ip", inverse)
        parts = lambda y: (f"floor({y}.l / {size(1)})", f"{y}.l % {size(1)}", f"floor({y}.r / {size(3)})", f"{y}.r % {size(3)}")
        return _with(pair, lambda y: "concat_ws('.', " + ", ".join(f"cast({p} + {x}[{i}].low as string)" for i, p in enumerate(parts(y))) + ")")

    octets = _map(f"split({m}, r'\\.')", lambda o: f"named_struct('v', cast({o} as bigint), 'low', cast(element_at(array(0, 10, 100), length({o})) as bigint), 'n', cast(element_at(array(10, 90, 156), length({o})) as bigint))")

    def ssn(area: str) -> str:
        pair = permute_pair(f"({area} - 1 - cast({area} > 666 as int)) * 99 + cast(substring({m}, 5, 2) as int) - 1", f"cast(substring({m}, 8, 4) as int) - 1", 898 * 99, 9999, "ssn", inverse)
        shown = lambda y: _with(f"cast(floor({y}.l / 99) as int) + 1", lambda v: f"concat_ws('-', lpad(cast({v} + cast({v} >= 666 as int) as string), 3, '0'), lpad(cast({y}.l % 99 + 1 as string), 2, '0'), lpad(cast({y}.r + 1 as string), 4, '0'))")
        return _with(pair, shown)

    a, b = DATE_SPAN

    def date(number: str, form: str) -> str:
        place = f"pmod({number}, {a * b})"
        return _with(permute_pair(f"floor({place} / {b})", f"{place} % {b}", a, b, "date", inverse), lambda y: f"date_format(date_add(date'1900-01-01', cast({number} - {place} + {y}.l * {b} + {y}.r as int)), '{form}')")

    def iban(bank: str) -> str:
        whole = f"concat(substring({m}, 1, 2), lpad(cast(98 - {_mod97(f'concat({bank}, substring({m}, 1, 2), {chr(39)}00{chr(39)})')} as string), 2, '0'), {bank})"
        spaced = lambda x: f"array_join({_map_at(f'split({m}, {_q})', lambda c, i: f'if({c} = {chr(39)} {chr(39)}, {c}, substring({x}, length({_compact(f"substring({m}, 1, {i})")}) + 1, 1))')}, '')"
        return _with(whole, spaced)

    sign = f"instr({m}, '@')"
    days = f"datediff({_day(m)}, date'1900-01-01')"
    made = {
        "iban": _with(permute_text(f"substring({_compact(m)}, 5)", "iban", inverse), iban), "email": f"concat({permute_text(f'substring({m}, 1, {sign} - 1)', 'email', inverse, wide=True)}, substring({m}, {sign}))",
        "iso_date": _with(days, lambda n: date(n, "yyyy-MM-dd")), "day_date": _with(days, lambda n: date(n, "dd/MM/yyyy")), "ssn": _with(f"cast(substring({m}, 1, 3) as int)", ssn), "ip": _with(octets, ip), "phone": _with(_digits(m), phone), "card": _with(_digits(m), card),
    }
    return f"case {kind} " + " ".join(f"when '{k}' then {x}" for k, x in made.items()) + f" else {m} end"


def _moved(unit: str, inverse: bool) -> str:
    """The pieces of a unit with pseudonyms in their places.

    Where new digits would make a unit with a card fall into other pieces than before, or show a date that wasn't there, its permutation is applied again until they
    don't (cycle walking), so that the inverse finds the same pieces. No printed layout reaches from a unit into another, so units walk by themselves.
    """
    text = lambda ps: f"array_join({_map(ps, lambda p: f'{p}.m')}, '')"
    shape = lambda ps: _map(ps, lambda p: f"named_struct('n', length({p}.m), 'kind', {p}.kind)")
    dated = lambda s: f"{s} rlike r'{DATED}'"
    settled = lambda ps: _with(text(ps), lambda s: f"{shape(f'flatten({_split_cards(s)})')} = {shape(ps)} and ({dated(s)}) = ({dated(text(unit))})")
    once = lambda ps: _map(ps, lambda p: _piece(_replaced(f"{p}.m", f"{p}.kind", inverse), f"{p}.kind"))
    step = lambda at, i: f"if({at}.done, {at}, {_with(once(f'{at}.ps'), lambda ps: f'named_struct({chr(39)}ps{chr(39)}, {ps}, {chr(39)}done{chr(39)}, if(exists({ps}, p -> p.kind = {chr(39)}card{chr(39)}), {settled(ps)}, true))')})"
    rounds = lambda at, i: f"if({at}.done, {at}, {_fold(f'sequence(1, {WALK[1]})', at, step)})"
    end = lambda at: f"if({at}.done, {at}.ps, cast(raise_error('a card number found no pseudonym') as {_PIECES}))"
    return _fold(f"sequence(1, {WALK[0]})", f"named_struct('ps', {unit}, 'done', not exists({unit}, p -> p.kind is not null))", rounds, end)


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """id_col, text with every personal value replaced, n_values, and a count for each of KINDS; one map pass, no Python.

    A value is replaced by another valid one of its own format: digits stay digits in their places, separators stay, card numbers pass
    Luhn and IBANs their remainder, dates are calendar days in the same notation. Each format has its own keyed permutation, the same in
    every row, so equal values get equal pseudonyms and different ones never meet; inverse=True with the same key takes it back. Cards are
    looked for in printed layouts within a run of digit groups, then in what is left of it as a whole. Where a run can be read in more than one
    way, a card can get another pseudonym than elsewhere, as else the inverse could not tell which groups were the card. Numbers that
    fail their check, and all other text, stay as they are. Null text: empty. Null ids and repeated rows: one result each;
    an empty table gives an empty result; other columns are left out.
    """
    moved = _map(f"regexp_extract_all(text, r'{ANY}', 0)", lambda m: f"flatten({_map(_units(m), lambda u: _moved(u, inverse))})")
    none = f"cast(array() as {_PIECES})"
    cut = f"flatten(zip_with(split(text, r'{ANY}', -1), concat(array({none}), {moved}), (p, f) -> concat(f, array({_piece('p', 'null')}))))"
    parts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.lit(key).alias("key")).select("id", F.expr(f"if(text rlike '[0-9@]', {cut}, array({_piece('text', 'null')}))").alias("parts"))
    of = lambda kind: F.expr(f"cast(size(filter(parts, p -> p.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return parts.select(
        F.col("id").alias(id_col), F.expr("array_join(transform(parts, p -> p.m), '')").alias("text"), F.expr("cast(size(filter(parts, p -> p.kind is not null)) as bigint)").alias("n_values"), *[of(k) for k in KINDS]
    )


#: The registered query's key; a user passes their own.
DEMO_KEY = "replace-this-key"


def op8_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), DEMO_KEY)
