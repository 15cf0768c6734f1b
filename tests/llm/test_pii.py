"""Pseudonyms against a second implementation in plain Python, row for row."""

import datetime as dt
import hashlib
import random

import regex

from gridlore.llm import pii

DAY0, DAYS = dt.date(1900, 1, 1), 17 * 4297
PLAIN = {k: p.replace(r"[\d", "[0-9").replace(r"\d", "[0-9]") for k, p in (*pii.PATTERNS.items(), ("run", pii.RUN))}
FOUND = regex.compile("|".join(f"(?:{p})" for p in PLAIN.values()))
LETTERS = [(chr(a), chr(b)) for a, b in (*pii.ASCII_RANGES, *pii.RANGES)]


def noise(key, tweak, i, other):
    return hashlib.sha256(f"{key}|{tweak}|{i}|{other}".encode()).hexdigest()


def steps(inverse):
    return range(pii.ROUNDS - 1, -1, -1) if inverse else range(pii.ROUNDS)


def shifted(part, digest, sign):
    out = []
    for j, c in enumerate(part):
        low, high = next(((ord(a), ord(b)) for a, b in LETTERS if a <= c <= b), (None, None))
        by = sign * int(digest[j % 16 * 4 :][:4], 16)
        out.append(c if low is None else chr(low + (ord(c) - low + by) % (high - low + 1)))
    return "".join(out)


def feistel_text(s, key, tweak, inverse):
    halves, sign = [s[: len(s) // 2], s[len(s) // 2 :]], -1 if inverse else 1
    for i in steps(inverse):
        halves[i % 2] = shifted(halves[i % 2], noise(key, tweak, i, halves[1 - i % 2]), sign)
    return "".join(halves)


def feistel_pair(pair, sizes, key, tweak, inverse):
    pair = list(pair)
    for i in steps(inverse):
        by = int(noise(key, tweak, i, pair[1 - i % 2])[:12], 16)
        pair[i % 2] = (pair[i % 2] + (-by if inverse else by)) % sizes[i % 2]
    return pair


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def luhn(s):
    total = 0
    for j, c in enumerate(reversed(digits(s))):
        v = int(c) * (1 + j % 2)
        total += v - 9 if v > 9 else v
    return total % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def day(m):
    try:
        return dt.date.fromisoformat(m) if "-" in m else dt.date(int(m[6:]), int(m[3:5]), int(m[:2]))
    except ValueError:
        return None


def kind_of(m):
    for kind in pii.PATTERNS:
        if not regex.fullmatch(PLAIN[kind], m):
            continue
        bare = m.replace(" ", "")
        if kind == "iban":
            ok = mod97(bare[4:] + bare[:4]) == 1
        elif kind == "email":
            ok = any(a <= c <= b for c in m[: m.index("@")] for a, b in LETTERS)
        elif kind.endswith("date"):
            ok = day(m) is not None
        elif kind == "ssn":
            ok = m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000"
        else:
            ok = True
        if ok:
            return kind
    return None


def card(s):
    return 13 <= len(digits(s)) <= 19 and luhn(s) == 0


def units(m):
    """Lists of pieces: a card after the stretch before it, and the last stretch."""
    kind = kind_of(m)
    return [[(m, kind)]] if kind or len(digits(m)) < 13 else split_cards(m)


def split_cards(m):
    groups = regex.findall("[^ -]+[ -]?", m)
    sizes = tuple(len(digits(g)) if regex.fullmatch("[0-9]+[ -]?", g) else 0 for g in groups)
    out, rest, i = [], "", 0

    def stretch():
        return [(rest, "card" if regex.fullmatch("[0-9 -]+", rest) and card(rest) else None)] if rest else []

    while i < len(groups):
        take = 1 if sizes[i] and card(groups[i]) else next((len(p) for p in pii.LAYOUTS if sizes[i : i + len(p)] == p and luhn("".join(groups[i : i + len(p)])) == 0), 0)
        if take:
            out.append([*stretch(), ("".join(groups[i : i + take]), "card")])
            rest = ""
        else:
            rest += groups[i]
        i += take or 1
    return out + [stretch()] if rest else out


def fill(shape, chars, keep):
    rest = iter(chars)
    return "".join(c if keep(c) else next(rest) for c in shape)


def replaced(m, kind, key, inverse):
    d = digits(m)
    other = lambda c: c not in "0123456789"
    if kind == "card":
        body = d[0] + feistel_text(d[1:-1], key, "card", inverse)
        return fill(m, body + str(-luhn(body + "0") % 10), other)
    if kind == "phone":
        kept = max(len(d) - 10, 0)
        return fill(m, d[:kept] + feistel_text(d[kept:], key, "phone", inverse), other)
    if kind == "iban":
        bank = feistel_text(m.replace(" ", "")[4:], key, "iban", inverse)
        return fill(m, f"{m[:2]}{98 - mod97(bank + m[:2] + '00'):02d}{bank}", lambda c: c == " ")
    if kind == "email":
        name, at, host = m.partition("@")
        return feistel_text(name, key, "email", inverse) + at + host
    if kind in ("iso_date", "day_date"):
        l, r = feistel_pair(divmod((day(m) - DAY0).days, 4297), (17, 4297), key, "date", inverse)
        new = DAY0 + dt.timedelta(l * 4297 + r)
        return new.isoformat() if kind == "iso_date" else f"{new.day:02d}/{new.month:02d}/{new.year}"
    if kind == "ssn":
        areas = [a for a in range(1, 900) if a != 666]
        l, r = feistel_pair((areas.index(int(m[:3])) * 99 + int(m[4:6]) - 1, int(m[7:]) - 1), (898 * 99, 9999), key, "ssn", inverse)
        return f"{areas[l // 99]:03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    if kind == "ip":
        of = {1: range(10), 2: range(10, 100), 3: range(100, 256)}
        parts = m.split(".")
        a, b, c, e = (of[len(p)] for p in parts)
        v = [of[len(p)].index(int(p)) for p in parts]
        l, r = feistel_pair((v[0] * len(b) + v[1], v[2] * len(e) + v[3]), (len(a) * len(b), len(c) * len(e)), key, "ip", inverse)
        return ".".join(str(x) for x in (a[l // len(b)], b[l % len(b)], c[r // len(e)], e[r % len(e)]))
    return m


DATED = regex.compile(r"(?:^|[^0-9-])(?:19|20)[0-9][0-9]-[01][0-9]-[0-3][0-9](?![0-9-])")


def moved(unit, key, inverse):
    once = lambda ps: [(replaced(v, k, key, inverse), k) for v, k in ps]
    text = lambda ps: "".join(v for v, _ in ps)
    read = lambda ps: [(len(v), k) for u in split_cards(text(ps)) for v, k in u]
    shape = [(len(v), k) for v, k in unit]
    now = once(unit)
    if any(k == "card" for _, k in unit):
        while read(now) != shape or bool(DATED.search(text(now))) != bool(DATED.search(text(unit))):
            now = once(now)
    return now


def twin(text, key, inverse=False):
    """The text with pseudonyms and the number of values of each kind."""
    out, at, kinds = [], 0, []
    for m in FOUND.finditer(text or ""):
        new = [p for u in units(m[0]) for p in moved(u, key, inverse)]
        out += [text[at : m.start()], *(v for v, _ in new)]
        kinds += [k for _, k in new if k]
        at = m.end()
    return "".join(out) + (text or "")[at:], {k: kinds.count(k) for k in pii.KINDS}


def check(rows, got):
    assert len(got) == len(rows)
    have = sorted((r["doc_id"], r["text"], r["n_values"], *(r[f"n_{k}"] for k in pii.KINDS)) for r in got)
    want = []
    for i, t, key, inverse in rows:
        text, n = twin(t, key, inverse)
        want.append((i, text, sum(n.values()), *n.values()))
    assert have == sorted(want)


def test_query_on_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"], pii.DEMO_KEY, False) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = pii.op8_pii_pseudonyms(spark, sf).collect()
    check(docs, got)
    assert sum(r["n_values"] for r in got) > 50


def test_awkward_values(spark, corpus):
    values = [
        "4785380592391139", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "4222 2222 2222 2", "41 111 11111111 11 1", "4111111111111112", "152.143.123.131", "8.8.8.8", "256.1.1.1", "+1 (743) 555-3824", "555-123-4567", "+49301234567",
        "jane.doe7@mail.example.com", "é.x@ex.org", "я.x@ex.org", "2024-02-29", "2023-02-29", "2024-13-01", "31/12/1999", "31/02/1999", "123-45-6789", "666-45-6789", "667-45-6789", "899-99-9999", "001-01-0001", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "SE45 5000 0000 0583 9825 7466", "GB83WEST12345698765432", "1234", "0.5", "١٢٣-٤٥-٦٧٨٩",
    ]
    around = ["{}", "a {}, b", "to {}.\n", "({})", "7 {} 2027", "{} 12/27", "{} 123", "{} {}", "{} 12.50", "2024-02-29 {} 123-45-6789", "\U0001f600 {}"]
    texts = [w.replace("{}", v) for v in values for w in around] + ["", None, "1 " * 3000, "1" * 3000, "a@" + "b." * 3000] + [f"{1000 + 37 * i} 4111 1111 1111 1111 {100 + i}" for i in range(100)]
    rows = [*enumerate(texts), *[(10_000 + i, t) for i, t in corpus]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.pseudonymize(df, "k").cache()
    check([(i, t, "k", False) for i, t in rows], out.collect())
    made = [(r["doc_id"], r["text"]) for r in out.collect()]
    check([(i, t, "k", True) for i, t in made], pii.pseudonymize(out.select("doc_id", "text"), "k", inverse=True).collect())
    out.unpersist()


def luhn_card(rng, sizes=(4, 4, 4, 4)):
    body = "".join(rng.choice("0123456789") for _ in range(sum(sizes) - 1))
    body += str(-luhn(body + "0") % 10)
    out = []
    for n in sizes:
        out.append(body[:n])
        body = body[n:]
    return out


def test_long_runs_of_cards(spark):
    """Runs of up to 200 cards beside numbers that could be part of them, there and back."""
    rng = random.Random(5)
    runs = [[g for _ in range(n) for g in ([f"{rng.randrange(10_000):04d}"] if beside else []) + luhn_card(rng, rng.choice(pii.LAYOUTS[:6]) if odd else (4, 4, 4, 4))] for n in (1, 20, 60, 200) for beside in (True, False) for odd in (True, False)]
    rows = [(i, sep.join(g)) for i, (g, sep) in enumerate((g, sep) for g in runs for sep in " -")]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").cache()
    check([(i, t, "k", False) for i, t in rows], out.collect())
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out.select("doc_id", "text"), "k", inverse=True).collect()}
    out.unpersist()
    assert back == dict(rows)


ADDRESSES = ["иван@mail.ru", "王@x.cn", "σωκράτης@ex.org", "łukasz.š@x.pl", "müller@x.de", "ýþÿøùú@x.is", "한글@x.kr", "ひらがな@x.jp", "ไทยแลนด์@x.th", "דוד@x.il", "محمد@x.eg", "हिन्दी@x.in", "გიორგი@x.ge", "ＡＢｃ@x.jp"]


def test_addresses_of_any_script(spark):
    """No address stays as it is, each keeps its length and comes back; one in which nothing can be moved is not counted."""
    rows = [*enumerate(ADDRESSES), (99, "._%+-@x.de"), (100, "\u0301@x.de")]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").cache()
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(ADDRESSES):
        new = got[i]["text"]
        assert got[i]["n_email"] == 1 and len(new) == len(t) and new.split("@")[1] == t.split("@")[1] and all(a != b for a, b in zip(new.split("@")[:1], t.split("@")[:1], strict=True))
    assert got[99]["n_email"] == got[100]["n_email"] == 0
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(out.select("doc_id", "text"), "k", inverse=True).collect()}
    out.unpersist()
    assert back == dict(rows)
    check([(i, t, "k", False) for i, t in rows], list(got.values()))
