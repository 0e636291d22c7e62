"""Personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  Beside them,
generators propose whatever might be personal data: written-out and defanged addresses
(``mail``, ``address``), account numbers (``iban``), and every stretch of whole digit
groups in a run of digits (``number``), so that proposals overlap: where a phone number and
a card stand side by side, the run is neither, but two of its stretches are.  Boosted trees
score each proposal by its format (length, grouping, separators, check digits, balance) and
its context (cue words before it, neighbouring characters, what of the run is left over); a
threshold per kind, 0.5 or more, set for ``PRECISION`` on examples kept out of training, decides; of
proposals that overlap, the best score stays; one that meets a base span gives way to it.

There are no labels for personal data, so the trees learn from examples made with a fixed
seed: true and look-alike items (dates, versions, order numbers, failing check digits)
written into contexts cut from a bounded sample of the corpus (``SAMPLE`` texts of at most
``SAMPLE_CHARS`` characters, by the hash of the id).  Everything else covers all rows.

Texts are scanned once, in Arrow batches, a bounded slice at a time; every pattern runs in
time linear in the text.

Defined cases: a null text counts as empty; texts without spans have zero counts and the
digest of the empty string; repeated rows are scanned one by one; offsets are code points;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rankaudit.llm.boosting import Boosted, threshold_for
from rankaudit.llm.scoring import scored

#: Texts that contexts of the training examples are cut from, their largest length, and the examples made.
SAMPLE, SAMPLE_CHARS, EXAMPLES = 2000, 20_000, 7000
#: One of so many false proposals is trained on, with that weight.
THIN = 4
SEED = 13
#: Precision that a kind's threshold keeps on the examples left out of training.
PRECISION = 0.99
#: Digits of a proposed stretch.
FEWEST, MOST = 7, 19
#: Characters of context looked at on either side, and proposals scored at once.
AROUND, TOGETHER = 40, 4096

BASE = ("email", "ip", "card", "phone")
ADDED = ("mail", "address", "iban", "number")
KINDS = BASE + ADDED

#: Fixed values of the contract (the address's local part is found from its @ backwards).
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    found = []
    last = 0
    for m in DOMAIN.finditer(text):
        start = _local_start(text, m.start(), last)
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    if not DIGIT.search(text):
        return found
    for m in DOTTED.finditer(text):
        if "." in m[0]:
            at, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(map(_byte, four)):
                    found.append((1, at, at + size))
                at += size + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() < 38:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((3, m.start(), m.end()))
    return found


_SIGN = r"(?:\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?|\x20at\x20)"
_STOP = r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\))\x20?|\x20dot\x20|\.)"
_HINT = re.compile(r"@|[(\[{][aA][tT]|\x20[aA][tT]\x20")
MAIL = re.compile(rf"{_SIGN}(?:[A-Za-z0-9-]++(?:{_STOP}))++[A-Za-z0-9-]++", re.I)
V4 = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[\[({]?\.[\])}]?\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])")
V6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
RUN = re.compile(r"[+(]{0,2}[0-9]++(?:[\x20()./-]{1,3}[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")


def candidates(text: str) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(kind, start, end, digits of its run before it, digits after it, how many of these
    two rests are card numbers) of all proposals."""
    if _HINT.search(text):
        for m in MAIL.finditer(text):
            start = _local_start(text, m.start(), 0)
            if start < m.start():
                yield 4, start, m.end(), 0, 0, 0
    if not DIGIT.search(text):
        return
    for pattern in (V4, V6) if ":" in text else (V4,):
        for m in pattern.finditer(text):
            yield 5, m.start(), m.end(), 0, 0, 0
    for m in IBAN.finditer(text):
        yield 6, m.start(), m.end(), 0, 0, 0
    for m in RUN.finditer(text):
        if m.end() - m.start() < FEWEST:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m[0])]
        upto = [0, *accumulate(b - a for a, b in groups)]
        digits = _NOT_DIGIT.sub("", m[0])
        for i, (a, _) in enumerate(groups):
            starts = [a]  # with and without the signs before it
            while starts[-1] > m.start() and text[starts[-1] - 1] in "+(":
                starts.append(starts[-1] - 1)
            for j in range(bisect_right(upto, upto[i] + FEWEST - 1), len(upto)):
                if upto[j] - upto[i] > MOST:
                    break
                rests = (digits[max(0, upto[i] - MOST - 1) : upto[i]], digits[upto[j] : upto[j] + MOST + 1])
                cards = sum(16 <= len(r) <= MOST and luhn(r) for r in rests)
                for a in starts:
                    yield 7, a, groups[j - 1][1], upto[i], upto[-1] - upto[j], cards


#: Words before an item that tell what it is, by meaning (fixed values).
CUES = {
    "call": ("phone", "tel", "telephone", "call", "mobile", "fax", "whatsapp", "telefon", "móvil", "appel"),
    "pay": ("card", "visa", "mastercard", "iban", "account", "bank", "karte", "tarjeta", "carte", "konto"),
    "write": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    "host": ("ip", "host", "address", "server", "login"),
    "other": ("isbn", "order", "no", "nr", "version", "v", "page", "pages", "id", "ref", "date", "issn", "invoice", "total", "tracking", "#", "$", "€", "£", "§"),
}
_CUE = {word: i for i, words in enumerate(CUES.values()) for word in words}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|[#$€£§]")
_SIGNS = (re.compile(r"[(\[{]at[)\]}]", re.I), re.compile(r"[(\[{](?:dot|\.)[)\]}]", re.I), re.compile(r"\x20(?:at|dot)\x20", re.I))


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c in ".,;:!?)]}\"'" else 3 if c.isalnum() else 2


def features(text: str, kind: int, start: int, end: int, before: int, after: int, cards: int) -> list[float]:
    """The numbers that the trees see: format, then context.  Only ``AROUND`` characters on
    either side count as context, so a proposal costs what it is long."""
    s = text[start:end]
    groups = GROUP.findall(s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups) if len(s) < 200 else ""
    letters = sum(c.isalpha() for c in s)
    pieces = re.split(r"[.:]", s)
    out = [
        kind == 4, kind == 5, kind == 6, kind == 7, len(s), sum(sizes), letters, len(groups), sizes[0], sizes[-1], max(sizes), min(sizes),
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count(":"), s.count("(") - s.count(")"), s.count("("),
        s[:1] == "+", s[:1] == "(", digits[:2] == "00", digits[:1] == "0", bool(digits) and luhn(digits), 13 <= len(digits) <= 19 and luhn(digits),
        sum(z == 4 for z in sizes) == len(sizes), len(pieces), max(map(len, pieces)), all(g and len(g) <= 3 and int(g) <= 255 for g in groups),
        "@" in s, *[bool(p.search(s)) for p in _SIGNS], len(re.findall(r"[^A-Za-z0-9]", s)), len(re.search(r"[A-Za-z]*$", s)[0]), "::" in s,
    ]
    rest = 1
    if kind == 6:
        flat = s.replace(" ", "")
        rest = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97
    left, right = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    told = [0] * len(CUES)
    for back, word in enumerate(reversed(_WORD.findall(left.lower())[-4:])):
        if word in _CUE:
            told[_CUE[word]] = max(told[_CUE[word]], 4 - back)
    out += [rest == 1, *told, _side(left[-1:]), _side(right[:1]), before, after, cards, bool(before) or bool(after), left[-1:] == "\n" or not left, len(left) - len(left.rstrip())]
    return [float(v) for v in out]


def _rows(text: str, proposals: list[tuple]) -> np.ndarray:
    return np.array([features(text, *p) for p in proposals])


# ---- made examples -------------------------------------------------------------------


class _Maker:
    """Items of personal data and look-alikes, from a seeded generator."""

    def __init__(self, rnd: np.random.Generator):
        self.rnd = rnd

    def pick(self, xs):
        return xs[int(self.rnd.integers(len(xs)))]

    def digits(self, n: int, first: str = "123456789") -> str:
        return self.pick(first) + "".join(str(v) for v in self.rnd.integers(0, 10, n - 1))

    def word(self, least: int = 3, most: int = 9) -> str:
        return "".join(self.pick("abcdefghijklmnoprstuvwyz") for _ in range(int(self.rnd.integers(least, most + 1))))

    def cut(self, digits: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for z in sizes:
            out.append(digits[at : at + z])
            at += z
        return sep.join(x for x in out + [digits[at:]] if x)

    def mail(self) -> str:
        name = self.word() + self.pick(["", ".", "_", "-"]) + self.pick([self.word(), str(self.rnd.integers(1, 99))])
        sign, stop = self.pick([("@", " [dot] "), (" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "{dot}"), ("@", "(dot)"), (" @ ", ".")])
        return name + sign + stop.join([self.word(3, 8)] + self.pick([[], [self.word(3, 8)]]) + [self.pick(["com", "org", "net", "de", "fr", "es", "io", "example"])])

    def address(self) -> str:
        if self.rnd.random() < 0.4:
            parts = ["%x" % v for v in self.rnd.integers(1, 65535, 8)]
            return ":".join(parts) if self.rnd.random() < 0.5 else ":".join(parts[:3]) + "::" + ":".join(parts[6:])
        return self.pick(["[.]", "(.)", " . ", "{.}", "[.]"]).join(str(v) for v in self.rnd.integers(1, 255, 4))

    def iban(self) -> str:
        country, size = self.pick([("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14)])
        body = self.digits(size)
        if country in ("GB", "NL"):
            body = self.word(4, 4).upper() + body[4:]
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        flat = f"{country}{check:02d}{body}"
        return flat if self.rnd.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, len(flat), 4))

    def card(self, true: bool = True) -> str:
        size = self.pick([16, 16, 16, 15, 19])
        body = self.digits(size - 1, "3456")
        last = next(d for d in "0123456789" if luhn(body + d))
        digits = body + (last if true else str((int(last) + int(self.rnd.integers(1, 10))) % 10))
        return self.cut(digits, [4, 6, 5] if size == 15 else [4] * 5, self.pick(["", "", "", " ", "-", ".", "  "]))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4, "0123456789")
        country = str(self.rnd.integers(1, 99))
        return self.pick([
            *[f"+{country} ({a}) {b}-{c}"] * 4, f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country}{a}{b}{c}",
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{country} {a} {b}{c}", f"0{a} {b}{c}", f"0{a}/{b}{c}", f"+{country}.{a}.{b}.{c}", f"+{country} / {a} / {b}{c}",
        ])

    def decoy(self) -> str:
        r = self.rnd.integers
        return self.pick([
            lambda: self.card(False), lambda: self.card(False), lambda: self.digits(int(r(7, 15))), lambda: self.digits(int(r(20, 40))),
            lambda: f"{r(1900, 2030)}-{r(1, 13):02d}-{r(1, 29):02d}", lambda: f"{r(1, 29):02d}.{r(1, 13):02d}.{r(1900, 2030)}", lambda: f"{r(1, 13):02d}/{r(1, 29):02d}/{r(1900, 2030)}",
            lambda: f"{r(0, 24):02d}:{r(0, 60):02d}:{r(0, 60):02d}", lambda: f"{r(1900, 2030)}-{r(1900, 2030)}", lambda: f"{r(1, 9)} {r(100, 999)} {r(100, 999)}",
            lambda: f"{r(1, 99)}.{r(0, 99)}.{r(256, 999)}.{r(0, 9)}", lambda: f"978-{r(0, 9)}-{r(10, 99)}-{r(100000, 999999)}-{r(0, 9)}", lambda: f"{r(1900, 2030)}{r(1, 13):02d}{r(1, 29):02d}-{r(1, 9999):04d}",
            lambda: f"{r(1, 999)}-{r(1, 999)} {r(1, 999)}-{r(1, 999)}", lambda: f"{self.word()} at {self.word()}.com", lambda: f"{self.word()} at {self.word()}.{self.word()}",
            lambda: f"3.{self.digits(int(r(7, 18)))}", lambda: f"{r(100, 999)}.{r(100, 999)}.{r(100, 999)},{r(10, 99)}", lambda: " ".join(str(v) for v in r(1, 50, int(r(4, 12)))),
            lambda: f"{self.pick('ABCDEFGHIJ')}{self.pick('KLMNOPQRST')}{r(10, 99)}{self.word(11, 18).upper()}", lambda: f"{r(10, 99)}:{r(10, 99)}", lambda: self.digits(32),
            lambda: "%x" % r(2**60, 2**62), lambda: f"AKIA{self.word(8, 8).upper()}{self.digits(8)}", lambda: f"{r(1, 9)}.{r(0, 20)}.{r(0, 20)}-{r(1000000, 9999999)}",
        ])()

    def item(self) -> tuple[str, str]:
        """An item of personal data, and the cue words that go with it."""
        kind = self.pick(["mail", "address", "iban", "card", "card", "phone", "phone", "phone"])
        cue = {"mail": "write", "address": "host", "iban": "pay", "card": "pay", "phone": "call"}[kind]
        return getattr(self, kind)(), cue


def _example(make: _Maker, texts: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """A made text and the spans of true items in it."""

    def context() -> str:
        t = make.pick(texts) if texts else ""
        at = int(make.rnd.integers(max(1, len(t) - 80)))
        return " ".join(t[at : at + 80].split(" ")[1:-1]) or make.word()

    out, spans = context() + make.pick([" ", " ", " ", "\n", " ("]), []
    beside = make.rnd.random() < 0.25  # numbers side by side, which the base patterns take for one
    for _ in range(int(make.pick([1, 1, 2, 2, 2, 3])) + beside):
        true = make.rnd.random() < 0.55 + 0.3 * beside
        item, cue = (make.decoy(), "other") if not true else (make.pick([make.phone, make.card])(), "call") if beside else make.item()
        if make.rnd.random() < 0.3:
            out += make.pick(CUES[cue]) + make.pick([": ", " ", " is "])
        if true:
            spans.append((len(out), len(out) + len(item)))
        out += item + make.pick([" ", " ", " ", " ", " ", " ", ", ", ". ", "; "])
    return out + context(), spans


def learn(texts: list[str]) -> tuple[Boosted, list[float]]:
    """Trees and a threshold per kind from made examples in the contexts of ``texts``."""
    make = _Maker(np.random.default_rng(SEED))
    x, y, kind, fold = [], [], [], []
    for i in range(EXAMPLES):
        text, spans = _example(make, texts)
        proposals = list(candidates(text))
        true = set(spans)
        x += [features(text, *p) for p in proposals]
        y += [(p[1], p[2]) in true for p in proposals]
        kind += [p[0] for p in proposals]
        fold += [i % 4 == 0] * len(proposals)
    x, y, kind, fold = np.array(x), np.array(y, float), np.array(kind), np.array(fold)
    used = ~fold & ((y == 1) | (np.arange(len(y)) % THIN == 0))  # most stretches are no items; some stand for all
    model = Boosted().fit(x[used], y[used], np.where(y[used] == 1, 1.0, THIN))
    kept = model.score(x[fold])
    of = [kind[fold] == k for k in range(len(BASE), len(KINDS))]
    return model, [max(0.5, threshold_for(kept[m], y[fold][m], PRECISION)) for m in of]


def sampled_texts(docs: DataFrame) -> list[str]:
    """At most ``SAMPLE`` texts of at most ``SAMPLE_CHARS`` characters, by the hash of doc_id."""
    usable = docs.select("doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS))
    share = min(1.0, 2.0 * SAMPLE / max(1, docs.count()))
    near = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return [r["text"] for r in near.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE).collect()]


def added_spans(text: str, base: list[tuple[int, int, int]], model: Boosted, thresholds: list[float]) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) of the proposals that the trees select, apart from each
    other and from the base spans."""
    chosen, some = [], []

    def weigh():
        for p, score in zip(some, model.score(_rows(text, some))):
            if score >= thresholds[p[0] - len(BASE)]:
                chosen.append((-score, p[1] - p[2], p[1], p[2], p[0]))
        some.clear()

    for p in candidates(text):
        some.append(p)
        if len(some) >= TOGETHER:
            weigh()
    if some:
        weigh()
    taken = _Apart((a, b) for _, a, b in base)
    return [(k, a, b, -neg) for neg, _, a, b, k in sorted(chosen) if taken.add(a, b)]


class _Apart:
    """Spans, the later of which may not meet the earlier."""

    def __init__(self, spans):
        self.starts, self.ends, most = [], [], 0
        for a, b in sorted(spans):  # those given may meet each other
            most = max(most, b)
            self.starts.append(a)
            self.ends.append(most)

    def add(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        if i and self.ends[i - 1] > a or i < len(self.starts) and self.starts[i] < b:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


_FOUND = ArrayType(StructType([StructField("kind", LongType()), StructField("start", LongType()), StructField("end", LongType())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ``found``, the array<struct<kind, start, end>> of its base
    and added spans (kind: index in KINDS) by kind and start, and ``redacted``, the text
    with every span replaced by its kind in brackets."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model, thresholds = learn(sampled_texts(docs))

    def make_scorer():
        def spans(part):
            found, redacted = [], []
            for text in part.column("text").to_pylist():
                base = base_spans(text)
                all_ = sorted(base + [x[:3] for x in added_spans(text, base, model, thresholds)])
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in all_])
                redacted.append(redact(text, all_))
            return {"found": found, "redacted": redacted}

        return spans

    return scored(docs, "text", make_scorer, [StructField("found", _FOUND), StructField("redacted", StringType())])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with the union of ``spans`` replaced, each stretch by its first span's kind."""
    out, at = [], 0
    for a, _, k, b in sorted((a, -b, k, b) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, redacted_sha256."""
    found = personal_data(docs)
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"], s["end"])), ",")

    def count(low, high):
        return F.size(F.filter("found", lambda s: s["kind"].between(low, high))).cast("long")

    return found.select(
        "doc_id", *[count(i, i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(joined(F.filter("found", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), count(len(BASE), len(KINDS)).alias("n_added"), F.sha2("redacted", 256).alias("redacted_sha256"),
    )
