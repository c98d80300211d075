"""Personal data: candidate spans, boosted trees on format and context, calibrated thresholds.

Base spans follow fixed formats (email, ip, card, phone) and always stay.  Generators of high recall propose
further spans, which may overlap: digit groups with separators, words around an at sign or its spellings.  Trees
boosted on the logistic loss score each candidate from its format and the characters around it.  They learn from a
bounded sample of rewritten base spans: in its own surroundings a span is put in obfuscated and national forms, which
are personal, and order numbers, dates, lists, sentences and digits with wrong checks take its place, which are not;
candidates of the corpus whose parts are not valid are not either.  What a base rule accepts is not learnt from, and
corpus candidates that could be either are left out.  Per kind, the threshold is the lowest score that keeps the
wanted precision on spans the trees have not seen in any form; a candidate above it that overlaps no base span is
added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import cut_lineage
from .kernels import slices, texts_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 6_000
"""Examples used for training, at most."""
PRECISION = 0.98
TREES, DEPTH, RATE = 40, 3, 0.3

EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; only the surroundings of at signs are read."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_BYTES:
            start -= 1
        host = EMAIL_HOST.match(text, at) if start < at else None
        if host:
            out.append((start, host.end()))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((3, m.start(), m.end()))
    return found


WIDE_DIGITS = re.compile(r"(?:\+|\(|\b)[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}")
WIDE_DOTS = re.compile(r"[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}")
WIDE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{1,64}){1,4}")
GENERATORS = ((0, WIDE_AT), (1, WIDE_DOTS), (2, WIDE_DIGITS), (3, WIDE_DIGITS))
DIGIT = re.compile(r"[0-9]")
NO_WORD = re.compile(r"[^A-Za-z0-9-]+")
CALL = re.compile(r"\b(?:call|tel|phone|mobile|fax|dial)\b", re.I)
ORDER = re.compile(r"\b(?:order|ref|no|invoice|serial|version|id|isbn)\b", re.I)
ENDINGS = frozenset("com org net edu gov io co uk de fr es eu us info biz ch at it nl ru jp cn in ca au example".split())


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed (kind, start, end), overlapping each other freely."""
    digits = DIGIT.search(text)
    at = "@" in text or "at]" in text or "at)" in text
    return [(kind, m.start(), m.end()) for kind, rule in GENERATORS if (at if kind == 0 else digits) for m in rule.finditer(text)]


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate as numbers."""
    own = text[start:end]
    digits = [c for c in own if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", own)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    values = [int(g[:6]) for g in groups] or [0]
    sizes, last, near = [len(g) for g in groups], NO_WORD.split(own)[-1], text[max(0, start - 16) : start]
    return [
        len(own), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), max(values),
        own.count("."), own.count("-"), own.count(" "), own.count("("), float(own[:1] == "+"), float(11 < len(digits) < 20 and luhn("".join(digits))),
        float(before == "+"), float(before.isalnum()), float(after.isalnum()), float(before in "=\"':/#"), float("@" in own), own.count(" @ ") + own.count("at"),
        sum(c.isalpha() for c in own), float(int(digits[0]) if digits else -1), float(kind == 3), len(own.rpartition(".")[2]),
        float(len(groups) == 4 and max(values) <= 255), float(sizes[-2:] == [3, 4] and len(sizes) == 3), float(sizes == [4, 4, 4, 4]),
        own.count(","), own.count(" ."), own.count(" . "), own.count("]") + own.count(")"), float(last.lower() in ENDINGS), float(last.islower()),
        float(CALL.search(near) is not None), float(ORDER.search(near) is not None), float(_plausible(kind, own)),
    ]


class Boosted:
    """Regression trees on the gradient of the logistic loss, thresholds per kind."""

    def __init__(self, trees: list, thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            total += _run(tree, x)
        return 1 / (1 + np.exp(-total))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, kind: np.ndarray, group: np.ndarray | None = None) -> Boosted:
        """Half of the groups (default: each row is one) grow the trees, the other half sets the thresholds."""
        grow = (np.arange(len(y)) if group is None else group) % 2 == 0
        xs, ys = x[grow], y[grow]
        model, total = Boosted([], []), np.zeros(len(ys))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in xs.T] if len(ys) else []
        for _ in range(TREES if len(ys) else 0):
            p = 1 / (1 + np.exp(-total))
            tree = _grow(xs, ys - p, p * (1 - p), cuts)
            model.trees.append(tree)
            total += _run(tree, xs)
        held = ~grow
        scores = model.score(x[held]) if held.any() else np.empty(0)
        for k in range(len(KINDS)):
            own = kind[held] == k
            s, t = scores[own], y[held][own]
            order = np.argsort(-s, kind="stable")
            good = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
            last = np.flatnonzero(np.append(s[order][1:] != s[order][:-1], True)[: len(order)])  # equal scores pass together
            fine = last[good[last] >= PRECISION]
            model.thresholds.append(float(max(0.5, s[order][fine[-1]])) if len(fine) else 2.0)
        return model


def _run(tree: dict, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[np.arange(len(x)), tree["column"][at]] > tree["cut"][at])
    return tree["value"][at]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> dict:
    """A full tree of fixed depth; a node without a useful split sends all rows left."""
    inner = (1 << DEPTH) - 1
    column, cut, value = np.zeros(2 * inner + 1, np.int64), np.full(2 * inner + 1, np.inf), np.zeros(2 * inner + 1)
    at = np.zeros(len(g), np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = (1e-6, 0, np.inf)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for c, options in enumerate(cuts):
            for option in options if len(rows) > 4 else ():
                left = x[rows, c] <= option
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, c, option)
        column[node], cut[node] = best[1], best[2]
        at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
    for leaf in range(inner, 2 * inner + 1):
        rows = at == leaf
        value[leaf] = RATE * g[rows].sum() / (h[rows].sum() + 1)
    return {"column": column, "cut": cut, "value": value}


def rewritten(kind: int, own: str, rng: np.random.Generator) -> list[tuple[str, str, float]]:
    """Other forms of a base span and things that look like them: (word before, form, whether it is personal)."""
    digits = "".join(c for c in own if "0" <= c <= "9")
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    if kind == 0:
        local, _, host = own.partition("@")
        parts = host.split(".")
        ends = [str(e) for e in rng.choice(sorted(ENDINGS), 3)]
        names = [(local, parts), (local, [*parts[:-1], ends[0]]), (word(), [word(), ends[1]]), (f"{word()}.{word()}", [word(), ends[2]])]
        spelled = ((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", " . "), (" [at] ", "."), (" @ ", "."))
        good = [name + at + dot.join(h) for name, h in names for at, dot in spelled]
        bad = [f"{word()}{at}{word()}{dot}{word().capitalize()}" for at in (" @ ", " (at) ", " [at] ", " @") for dot in (". ", ".")]
        bad += [f"{word()}{at}{word()}. {word()}" for at in (" @ ", " (at) ", " [at] ")]
        return [("", x, 1.0) for x in good] + [("", x, 0.0) for x in bad]
    if kind == 1:
        octets = [own.split("."), [str(v) for v in rng.integers(0, 256, 4)]]
        good = [sep.join(x) for x in octets for sep in (" . ", " .")]
        values = [[str(v) for v in rng.integers(0, top, 4)] for top in (20, 256, 1000)]
        bad = [sep.join(x) for x in values for sep in (", ", ",", ". ")]
        bad += [sep.join(str(v) for v in rng.integers(256, 1000, 4)) for sep in (" . ", ".", " .")]
        return [("", x, 1.0) for x in good] + [("", x, 0.0) for x in bad]
    if kind == 2:
        def cut(x: str, sep: str) -> str:
            return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

        wrong = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
        out = [("", cut(digits, sep), 1.0) for sep in (".", "/", " - ", "  ", "--")]
        return out + [("", cut(wrong, sep), 0.0) for sep in (".", "/", " - ", "  ", "--", " ", "-", "")]
    out = []
    for d in (digits[-10:], number(10)):
        a, b, c = d[:-7], d[-7:-4], d[-4:]
        forms = (f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")
        call, order = str(rng.choice(["call ", "tel ", "phone: "])), str(rng.choice(["order ", "ref ", "invoice no "]))
        out += [(before, x, 1.0) for x in forms for before in ("", call)] + [(call, d, 1.0)]
        out += [(before, d, 0.0) for before in ("", order)] + [(order, x, 0.0) for x in forms[2:]]
    day = f"{rng.integers(1, 13):02}-{rng.integers(1, 29):02}"
    bare = [f"20{number(2)}-{day}", f"20{number(2)}-{day} {number(2)}", f"{number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}"]
    bare += [number(n) for n in (7, 8, 12, 16)] + [f"{number(8)}f{number(3)}ab", f"{number(4)} {number(4)}", f"{number(1)}.{number(2)}.{number(5)}", f"{number(5)}-{number(5)}"]
    return out + [(before, x, 0.0) for x in bare for before in ("", order)]


def _plausible(kind: int, own: str) -> bool:
    """Whether the parts of a candidate are those of its kind, whatever stands between them."""
    sizes = [len(g) for g in re.findall(r"[0-9]+", own)]
    if kind == 0:
        return True
    if kind == 1:
        return "," not in own and all(int(g) <= 255 for g in re.findall(r"[0-9]+", own))
    if kind == 2:
        return 13 <= sum(sizes) <= 19 and luhn("".join(c for c in own if "0" <= c <= "9"))
    return 7 <= sum(sizes) <= 15 and len(sizes) > 1


def _examples(sure: bool, kind: int, text: str, start: int, end: int) -> list[tuple[int, float, list[float]]]:
    """(kind, label, features) of the forms of a base span (``sure``), or of a candidate that is no personal data."""
    if not sure:
        return [(kind, 0.0, describe(text, kind, start, end))]
    own, out = text[start:end], []
    for word, form, label in rewritten(kind, own, np.random.default_rng(hash_of(f"{kind}{own}"))):
        ahead = text[:start] + word
        whole, at = ahead + form + text[end:], (len(ahead), len(ahead) + len(form))
        base = base_spans(whole)
        for k, a, b in candidates(whole):
            if a < at[1] and at[0] < b and not any(x < b and a < y for _, x, y in base):
                out.append((k, label * ((k, a, b) == (kind, *at)), describe(whole, k, a, b)))
    return out


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans (sure) and candidates whose parts are not valid, with 20 characters around; ``turn`` orders them for
    the bounded sample."""
    for batch in batches:
        out = []
        for raw in texts_of(batch.column(0)):
            text = raw.decode()
            base = base_spans(text)
            other = [c for c in candidates(text) if not any(x < c[2] and c[1] < y for _, x, y in base) and not _plausible(c[0], text[c[1] : c[2]])]
            for sure, (k, a, b) in [*((True, c) for c in base), *((False, c) for c in other)]:
                at = max(0, a - 20)
                out.append((hash_of(f"{k}{text[a:b]}"), sure, k, text[at : b + 20], a - at, b - at))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["turn", "sure", "kind", "own", "start", "end"])


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) >> 1


def fit_pii(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> Boosted:
    """Fit on at most ``sample`` examples from ``docs``, those whose spans hash lowest; each kind of base span and the
    other candidates have shares of their own, so that rare kinds are learnt too."""
    found = cut_lineage(docs.select(text).mapInArrow(_sources, "turn bigint, sure boolean, kind int, own string, start int, end int"))
    once = found.groupBy("turn", "sure", "kind").agg(F.min(F.struct("own", "start", "end")).alias("at"))
    table = once.select("turn", "sure", "kind", "at.*")
    parts = [table.where(F.col("sure") & (F.col("kind") == k)).orderBy("turn").limit(sample // 100) for k in range(len(KINDS))]
    parts.append(table.where(~F.col("sure")).orderBy("turn", "kind").limit(sample // 3))
    chosen = sorted(tuple(r) for part in parts for r in part.collect())
    rows = [(turn, *e) for turn, *source in chosen for e in _examples(*source)][:sample]
    turn, kind, label, x = zip(*rows) if rows else ((), (), (), ())
    return Boosted.fit(np.array(x, float).reshape(len(rows), len(describe("", 0, 0, 0))), np.array(label, float), np.array(kind, int), np.array(turn, np.int64))


def all_spans(text: str, model: Boosted) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans): added ones overlap no base span and no better added one."""
    base, found = base_spans(text), candidates(text)
    if not found:
        return base, []
    score = model.score(np.array([describe(text, *c) for c in found]))
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for i in sorted(range(len(found)), key=lambda i: (-score[i], found[i])):
        k, a, b = found[i]
        if score[i] >= model.thresholds[k] and not any(x < b and a < y for x, y in taken):
            added.append((k, a, b))
            taken.append((a, b))
    return base, sorted(added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first kind names the whole."""
    out, at = [], 0
    merged: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _find(model: Boosted, redact: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = texts_of(batch.column(batch.schema.get_field_index("_text")))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            for i, j in slices(raws):
                counts, base_text, spans_text, texts = [], [], [], []
                for raw in raws[i:j]:
                    text = raw.decode()
                    base, added = all_spans(text, model)
                    counts.append(np.bincount([k for k, _, _ in base], minlength=4).tolist() if base else [0, 0, 0, 0])
                    base_text.append(joined(base))
                    spans_text.append(joined(base + added) if added else base_text[-1])
                    texts.append(redacted(text, base + added) if redact and (base or added) else text if redact else None)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)],
                     pa.array(base_text, pa.string()), pa.array(spans_text, pa.string()), pa.array(texts, pa.string())],
                    names=[*[part.schema.names[c] for c in keep], *[f"n_{k}" for k in KINDS], "base", "spans", "redacted"],
                )

    return find


def find_pii(docs: DataFrame, model: Boosted, keep: list[str] | None = None, text: str = "text", redact: bool = False) -> DataFrame:
    """Columns ``keep`` (default doc_id) with n_email, n_ip, n_card, n_phone (base spans), base and spans
    (kind:start:end in code points, by kind, then start, comma-joined), and with ``redact`` the redacted text.

    Null texts count as empty; repeated rows and null keys come back as they are; an empty table gives an empty
    result.  Columns named as the results must not be among ``keep``.
    """
    keep = ["doc_id"] if keep is None else keep
    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "_text")
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return read.mapInArrow(_find(model, redact), f"{kinds}, {counts}, base string, spans string, redacted string")
