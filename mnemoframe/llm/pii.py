"""Personal data: base patterns, and spans beyond them that boosted trees select.

Generators of high recall propose overlapping spans of each kind: numbers in other groupings, parts of runs of digits
from group to group, addresses that are spelled out, and whatever resembles the kind. Each candidate has features of its
format, taken from a normal form without the marks of the base patterns. The trees are trained on candidates whose label
follows from a check that their features don't show: a checksum, the range of an address's parts, a known top-level domain,
a leading plus sign, or the words around them; all such candidates are trained on. Thresholds are chosen, per kind, for a precision: on all of
them, each judged by trees that haven't seen it, or, where the label is a check, from how often numbers of a form pass it by chance. A candidate that fails its check is never added. Base spans always stay; a chosen span that overlaps a base span is left out,
and so is one that overlaps a likelier one of its kind.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm import boosting
from mnemoframe.llm.common import add_columns, batches, materialize

KINDS = ("email", "ip", "card", "phone")
#: Parts of the labelled candidates; each is judged by trees grown on the others, for calibration and thresholds.
FOLDS = 4
#: Precision, of labelled candidates judged by trees that haven't seen them, from which on a candidate is taken for personal data.
PRECISION = 0.98

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT_SPELT = re.compile(r"(?i)(?:\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s|\s@\s|@)")
_DOMAIN_SPELT = re.compile(r"(?i)[a-z0-9-]{1,63}(?:(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\.)[a-z0-9-]{1,63}){1,5}")
_DIGITS = re.compile(r"[0-9][0-9 ().\-/:_]{5,}[0-9]")
#: Groups of digits in a part of a run, at most; whole runs of up to 42 characters are proposed whatever their groups.
GROUPS = 6
_DATE = re.compile(r"(?<![0-9])(?:1[89]|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9](?![0-9])|(?<![0-9])[0-3]?[0-9][-/.][01]?[0-9][-/.](?:1[89]|20)[0-9]{2}(?![0-9])")
_IP_SPELT = re.compile(r"(?i)(?<![0-9])[0-9]{1,3}(?:(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s|\.)[0-9]{1,3}){3}(?![0-9])")
#: Words near personal data, by kind.
CUES = {
    "email": ("mail", "contact", "write", "address", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "mobil"),
}
#: Words right in front of numbers that are something else.
OTHER = re.compile(r"(?i)\b(?:id|order|build|version|isbn|invoice|ref|serial|item|sku|ticket|page|nr|no)\b[.:#]?\s*$")
TLDS = frozenset("com org net edu gov info io de fr es eu uk us ch at it nl".split())


#: Place, among the features, of whether the run of digits goes on behind the span.
_GOES_ON = 17
_GROUP = re.compile("[0-9]+")
_RUN_BEFORE, _RUN_AFTER = re.compile(r"[0-9][ ().\-/:_]{1,3}$"), re.compile(r"[ ().\-/:_]{1,3}[0-9]")
_PLUS_BEFORE = re.compile(r"\+[0-9 ().\-]+$")
_MARKED = re.compile(r"(?i)[\[({<]\s?(?:at|dot)\s?[\])}>]|\sdot\s")


def _normal(s: str, kind: int) -> str:
    """A span as the base patterns' form of it would read, without a leading plus sign."""
    if kind == 0:
        return re.sub(r"(?i)\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s", ".", _AT_SPELT.sub("@", s, count=1))
    if kind == 1:
        return ".".join(_GROUP.findall(s))
    return s.removeprefix("+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ip_fits(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed. Leftmost matches that don't overlap inside a kind; a match that fails its check is dropped."""
    out, stop = [], 0
    for m in _AT.finditer(text):
        a = m.start()
        while a > stop and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, 0, m.end()))
            stop = m.end()
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_fits(m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return [(KINDS[k], a, z) for a, k, z in sorted(out)]


def _candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end), overlapping and of high recall."""
    for m in _AT_SPELT.finditer(text):
        a, low = m.start(), max(0, m.start() - 64)
        while a > low and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start() and (d := _DOMAIN_SPELT.match(text, m.end())):
            yield 0, a, d.end()
    for m in _IP_SPELT.finditer(text):
        yield 1, *m.span()
    for m in _DIGITS.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for i, (first, _) in enumerate(groups):
            a = first
            if a and text[a - 1] in "+(":
                a -= 1
                if a and text[a] == "(" and text[a - 1] == "+":
                    a -= 1
            n, whole = 0, i == 0 and m.end() - m.start() <= 42
            for k in range(i, len(groups) if whole else min(i + GROUPS, len(groups))):
                n, z = n + groups[k][1] - groups[k][0], groups[k][1]
                if n > 19:
                    break
                if k - i >= GROUPS and k + 1 < len(groups):
                    continue
                if 12 <= n:
                    yield 2, first, z
                if 8 <= n <= 15:
                    yield 3, a, z


def _goes_on(text: str, a: int, z: int) -> tuple[bool, bool]:
    """Whether the run of digits that a span is taken from goes on before it, and behind it."""
    return _RUN_BEFORE.search(text, max(0, a - 4), a) is not None, _RUN_AFTER.match(text, z) is not None


def features(text: str, kind: int, a: int, z: int) -> list[float]:
    """Of the normal form and what is next to it; no checksum, value, sign, top-level domain or cue word is among them."""
    s, bare = _normal(text[a:z], kind), kind == 0 and "@" not in text[a:z] and _MARKED.search(text[a:z]) is None
    digits = sum(map(str.isdigit, s))
    groups = _GROUP.findall(s)
    parts = re.split(r"[^A-Za-z0-9]+", s)
    on = _goes_on(text, a, z) if kind > 1 else (False, False)
    return [
        float(kind), len(s), digits, digits / max(len(s), 1), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), float(len(set(map(len, groups))) == 1), len(groups[0]) if groups else 0,
        s.count("."), s.count("-"), s.count(" "), float(s.count("/") + s.count(":") + s.count("_")), float("(" in s), len(parts[-1]) if kind else 0, float(bare), float(on[0]), float(on[1]),
        float(text[a - 1 : a] in {*"\"'=_-/"}), float(text[z : z + 1] in {*"\"'=_-/"}),
    ]


def weak_label(text: str, kind: int, a: int, z: int) -> int | None:
    """1 or 0 from a check, None where no check says."""
    s = text[a:z]
    digits = re.sub("[^0-9]", "", s)
    cue = any(c in text[max(0, a - 40) : a].lower() for c in CUES[KINDS[kind]])
    if kind == 0:
        known = re.split(r"[^A-Za-z]+", s)[-1].lower() in TLDS
        if "@" in s and " " not in s:
            return 1 if known else None
        return int(known and ("@" in s or _MARKED.search(s) is not None or cue))
    if kind and OTHER.search(text, max(0, a - 12), a):
        return 0
    if kind == 1:
        return int(_ip_fits(_GROUP.findall(s)))
    glued = text[a - 1 : a].isalnum() or text[z : z + 1].isalnum()
    groups = _GROUP.findall(s)
    if glued or any(m.end() > a and m.start() < z for m in _DATE.finditer(text, max(0, a - 10), z + 10)) or (len(groups) == 4 and s.count(".") == 3 and _ip_fits(groups)):
        return 0
    if kind == 2:
        return int(luhn(digits) and len(set(digits)) > 2)
    before, after = _goes_on(text, a, z)
    if s[:1] == "+":
        return None if after else 1
    if before or after:
        # A part counts if the cue is right in front of it. The rest of a number with a plus sign isn't one by itself.
        if not before and cue and re.search(r"[A-Za-z][:.]?\s?$", text[max(0, a - 3) : a]):
            return None
        return 0 if s[:1] != "(" and before and _PLUS_BEFORE.search(text, max(0, a - 20), a) else None
    return 1 if cue and len(groups) > 1 else 0 if len(groups) == 1 and not cue else None


def _scan(texts: list[str | None]) -> dict:
    base, cand = [], []
    for t in texts:
        t = t or ""
        base.append([{"kind": k, "a": a, "z": z} for k, a, z in base_spans(t)])
        cand.append([{"kind": k, "a": a, "z": z, "x": features(t, k, a, z), "y": weak_label(t, k, a, z), "r": chance(k, _GROUP.findall(t[a:z]))} for k, a, z in _candidates(t)])
    return {"_base": base, "_cand": cand}


_SCANNED = "_base array<struct<kind:string, a:int, z:int>>, _cand array<struct<kind:int, a:int, z:int, x:array<float>, y:int, r:float>>"


#: Kinds whose label is a check.
CHECKED = (1, 2)


def chance(kind: int, groups: list[str]) -> float:
    """How often numbers of a form pass the check of their kind by chance: one in ten has a right check digit, parts of an address are at most 255 as often as numbers of so many digits."""
    if kind == 1:
        return float(np.prod([156 / 900 if len(g) == 3 else float(len(g) < 3) for g in groups]))
    return 0.1 if kind == 2 else 0.0


@dataclass
class Detector:
    trees: boosting.Trees | None
    limit: list[float]

    def chosen(self, cand: list[dict]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of candidates over their limit that no check refuses, the likeliest first; of equals, those that end their run of digits, then the longest."""
        cand = [c for c in cand if c["y"] != 0]
        if not cand or self.trees is None:
            return []
        p = self.trees.probability(np.array([c["x"] for c in cand])).round(6)
        # Of addresses and cards the trees tell how many of a form pass their check; that those which do are real is likelier, as few pass by chance.
        by_chance = np.array([c["r"] for c in cand])
        p = np.where((by_chance > 0) & (by_chance < 1), 1 - np.minimum(1, by_chance * (1 - p) / ((1 - by_chance) * np.maximum(p, 1e-6) + 1e-12)), p).round(6).tolist()
        over = [(-q, c["x"][_GOES_ON], c["a"] - c["z"], c["a"], c["kind"], c["z"]) for c, q in zip(cand, p, strict=True) if q >= self.limit[c["kind"]]]
        return [(a, k, z) for *_, a, k, z in sorted(over)]


def _apart(chosen: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``chosen`` that overlap no base span and none of their kind before them."""
    out: list[tuple[int, int, int]] = []
    held = [sorted((a, z) for a, k, z in base if k == own) for own in range(len(KINDS))]  # those of a kind don't overlap one another
    taken = [list(h) for h in held]
    for a, k, z in chosen:
        for spans in (*held[:k], taken[k], *held[k + 1 :]):
            i = bisect.bisect_left(spans, (z,))
            if i and spans[i - 1][1] > a:
                break
        else:
            bisect.insort(taken[k], (a, z))
            out.append((a, k, z))
    return out


def train(scanned: DataFrame, precision: float = PRECISION) -> Detector:
    """Fitted on all labelled candidates. With candidates of one class or none, no span is added."""
    some = scanned.select(F.explode("_cand").alias("c")).where("c.y is not null")
    fold = F.pmod(F.xxhash64("c.x", "c.a"), F.lit(FOLDS)).cast("int")
    counts = some.groupBy(F.col("c.x").alias("x"), fold.alias("fold")).agg(F.count("*").alias("n"), F.sum("c.y").alias("pos"))
    fitted = boosting.fit_table(materialize(counts, "formats"), FOLDS)
    if fitted is None:
        return Detector(None, [1.1] * len(KINDS))
    trees, tally = fitted
    limit = []
    for k in range(len(KINDS)):
        m, pos, n = (tally.loc[tally["first"] == k, c].to_numpy() for c in ("m", "pos", "n"))
        if k in CHECKED:  # the labels are the check itself, which what is added has passed: the likelihood behind it counts
            limit.append(precision if len(m) else 1.1)
            continue
        p = trees.calibrated(m)
        least = boosting.threshold(p, pos, precision, n)
        # Halfway to the next row below, so that a candidate needn't be as likely as the least likely row taken.
        under = p[p < least].max(initial=0.0)
        limit.append(max(0.5, (least + under) / 2) if least <= 1 else least)
    return Detector(trees, limit)


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None, precision: float = PRECISION) -> DataFrame:
    """``docs`` (or its columns ``keep``) with base (array of kind, start, end) and spans (base and added ones).

    Offsets are code points, ends exclusive; both arrays are by start, then kind as in KINDS. Every row, repeated or not,
    gives one row; null and empty texts have no spans. Input columns named like a new one are replaced.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)], F.col(f"`{text}`").alias("_text"))
    scanned = materialize(add_columns(named, "_text", _SCANNED, _scan, [c for c in named.columns if c != "_text"]), "pii")
    detector = train(scanned, precision)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 5000):
            n = b.num_columns
            all_base, all_spans = [], []
            for base, cand in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True):
                own = [(s["a"], KINDS.index(s["kind"]), s["z"]) for s in base]
                added = _apart(detector.chosen(cand), own)
                as_rows = lambda found: [{"kind": KINDS[k], "start": a, "end": z} for a, k, z in sorted(found)]
                all_base.append(as_rows(own))
                all_spans.append(as_rows({*own, *added}))
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(all_base, kind), pa.array(all_spans, kind)], names=[*b.schema.names[: n - 2], "base", "spans"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scanned.schema if f.name not in ("_base", "_cand"))
    spans = "array<struct<kind:string, start:int, end:int>>"
    out = scanned.mapInArrow(choose, f"{kept + ', ' if kept else ''}base {spans}, spans {spans}")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], "base", "spans")


def redact(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    named = docs.select(*[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(docs.columns)])
    at = f"_d{docs.columns.index(text)}"
    found = find_pii(named, at, **how)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2000):
            i, out = b.schema.get_field_index(at), []
            for t, spans in zip(b.column(i).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if t is None:
                    out.append(None)
                    continue
                parts, end = [], 0
                for s in spans:
                    if s["start"] >= end:
                        parts += [t[end : s["start"]], f"[{s['kind']}]"]
                    end = max(end, s["end"])
                out.append("".join([*parts, t[end:]]))
            cols = list(b.columns[:-2])
            cols[i] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-2])

    return found.mapInArrow(cut, found.drop("base", "spans").schema).toDF(*docs.columns)
