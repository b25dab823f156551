"""PII by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Base spans follow four fixed patterns and always stay. Looser patterns propose further spans: addresses written
with (at) and [dot], phone numbers without a plus sign, card numbers that miss the checksum, IPs with [.]. On every
span five labelers vote yes, no or nothing: the strict pattern, the shape of the number or address, a gazetteer
(domains, issuer prefixes, reserved networks), the words before it, and the characters around it. How often each
combination of votes and features occurs is counted by Spark over all rows; these counts, a table bounded by the
number of combinations, go to the driver, where expectation-maximisation estimates each labeler's reliability by
kind and trains a logistic classifier on the posteriors. A proposed span is added if the classifier is sure of it and
no base span overlaps it.

Defined results: null and empty texts have no spans; repeated rows get the same spans each; a column named as a
result is not carried over; an empty table gives an empty table (and nothing to learn, so nothing is added).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import by_bytes, guarded, stored

#: Kinds in the order of ties.
KINDS = ("email", "ip", "card", "phone")
BATCH_BYTES = 16_000_000
#: Least probability of an added span.
SURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[{](?:at|AT)[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{](?:dot|DOT)[)\]}])\x20?[A-Za-z0-9-]{1,63}){1,5}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
#: The gazetteer and the context words.
DOMAINS = frozenset("com org net edu gov mil int info biz name pro io ai app dev co me tv us ca mx br ar cl pe ve uk ie fr de at ch nl be lu es pt it gr pl cz sk hu ro bg se no dk fi is ee lv lt ru ua tr il ae sa za eg ng ke in pk cn hk tw jp kr sg my th vn ph id au nz eu cat example".split())
CUES = {
    "email": frozenset("mail email contact write address reach".split()),
    "ip": frozenset("ip host server address from login node".split()),
    "card": frozenset("card visa mastercard amex credit payment pay cc".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact whatsapp".split()),
}
AGAINST = frozenset("version isbn order id total figure page section sku model serial build release".split())


def digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(n: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(n))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ in linear time: the local part is the run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start and kind."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))] if "." in text else []
        found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(n := digits(m[0])) <= 19 and luhn(n)]
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15] if "+" in text else []
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def proposed(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the looser patterns that no base span (sorted by start) overlaps."""
    found, starts, reach = [], [a for _, a, _ in base], [*accumulate((b for *_, b in base), max)]
    free = lambda a, b: not (i := bisect_left(starts, b)) or reach[i - 1] <= a
    for kind, pattern in _LOOSE.items():
        if ("[" in text or "(" in text or "{" in text) if kind in ("email", "ip") else _DIGIT.search(text):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if free(*m.span())]
    return found


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """1, -1 or 0 of each labeler, then the features: the number of digits and of separators, in classes."""
    span, n = text[start:end], digits(text[start:end])
    before = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())[-5:]
    around = text[start - 1 : start] + text[end : end + 1]
    regex = 1 if strict else -1 if kind == "card" else 0
    if kind == "email":
        tail = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}"))[-1].lower()
        shape, known = (1 if len(tail) >= 2 and not tail.isdigit() else -1), (1 if tail in DOMAINS else 0)
    elif kind == "ip":
        parts = [int(p) for p in re.findall(r"[0-9]+", span) if len(p) < 9]
        shape, known = (1 if all(p < 256 for p in parts) and len(parts) == 4 else -1), (-1 if parts[:1] in ([0], [127]) or max(parts, default=0) < 10 else 1)
    elif kind == "card":
        shape, known = (1 if len(n) in (15, 16) else 0), (1 if n[0] in (4, 5) or n[:2] in ([3, 4], [3, 7]) or n[:4] == [6, 0, 1, 1] else -1)
    else:
        shape, known = (1 if 10 <= len(n) <= 15 and len(set(n)) > 2 else -1), (1 if "(" in span or span[0] == "+" else 0)
    context = -1 if AGAINST & set(before) else 1 if CUES[kind] & set(before) else 0
    return regex, shape, known, context, (-1 if re.search(r"[A-Za-z0-9]", around) else 1), min(len(n) // 4, 5), min(len(re.findall(r"[^A-Za-z0-9]", span)), 4)


LABELERS = 5


def estimated(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes and features). Two classes, labelers independent given the class, a pseudo-count
    of 8 votes at a reliability of 0.8. The fixed pattern is a labeler like others, so what it finds is weighed by the
    others' votes too; the shares of personal data among its spans and among proposed ones are estimated apart, since
    strict matches say nothing about what looser patterns bring."""
    out = {}
    for kind in KINDS:
        rows = sorted((k, n) for k, n in counts.items() if k[0] == kind)
        if not rows:
            continue
        v, n = np.array([k[1][:LABELERS] for k, _ in rows]), np.array([c for _, c in rows], float)
        base = v[:, 0] > 0
        right, wrong, prior = np.full(LABELERS, 0.8), np.full(LABELERS, 0.2), np.where(base, 0.9, 0.2)
        for _ in range(rounds):
            like = [np.prod(np.where(v > 0, r, np.where(v < 0, 1 - r, 1.0)), 1) * p for r, p in ((right, prior), (wrong, 1 - prior))]
            q = like[0] / np.maximum(like[0] + like[1], 1e-300)
            for some, first, low, high in ((base, 0.9, 0.5, 0.99), (~base, 0.2, 0.01, 0.5)):
                prior[some] = np.clip((q @ (n * some) + 10 * first) / ((n * some).sum() + 10), low, high)
            for rate, weight, first in ((right, q * n, 0.8), (wrong, (1 - q) * n, 0.2)):
                yes, no = weight @ (v > 0), weight @ (v < 0)
                rate[:] = (yes + 8 * first) / (yes + no + 8)
        out |= {k: float(x) for (k, _), x in zip(rows, q, strict=True)}
    return out


def classifier(counts: dict, posterior: dict, steps: int = 400) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of each (kind, votes and features) by a logistic classifier trained on the posteriors, weighted by counts."""
    keys = sorted(counts)
    if not keys:
        return {}
    features = np.array([[*(float(k[0] == kind) for kind in KINDS), *(float(x > 0) for x in k[1][:LABELERS]), *(-float(x < 0) for x in k[1][:LABELERS]), k[1][5] / 5, k[1][6] / 4] for k in keys])
    y, weight = np.array([posterior[k] for k in keys]), np.sqrt(np.array([counts[k] for k in keys], float))
    weight, w = weight / weight.sum(), np.zeros(features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-features @ w))
        h = features.T @ (features * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]) + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, features.T @ (weight * (p - y)) + 1e-3 * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-features @ w))).tolist(), strict=True))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the text, with `found`: array of (kind, start, end, base, votes)."""
    rest = [f for f in df.schema.fields if f.name != text]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32()))]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found = []
            for t in batch.column("text").to_pylist():
                base = base_spans(t or "")
                spans = [(*s, True) for s in base] + [(*s, False) for s in (proposed(t, base) if t else ())]
                found.append([{"kind": k, "start": a, "end": b, "base": is_base, "votes": list(votes(t, k, a, b, is_base))} for k, a, b, is_base in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, kind)], names=[*(f"c{i}" for i in range(len(rest))), "found"])

    named = df.select(F.col(text).alias("text"), *(F.col(f.name).alias(f"c{i}") for i, f in enumerate(rest)))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rest)), "found array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>>>"])
    return named.mapInArrow(find, schema).toDF(*(f.name for f in rest), "found")


def learnt(found: DataFrame) -> dict[tuple[str, tuple[int, ...]], float]:
    """The classifier's probability of every combination seen. Combinations are few (votes and small classes), however many spans there are."""
    rows = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    counts = {(r.kind, tuple(r.votes)): r["count"] for r in rows}
    return classifier(counts, estimated(counts))


def decided(found: DataFrame) -> frozenset[tuple[str, tuple[int, ...]]]:
    """Combinations whose proposed spans are added."""
    return frozenset(k for k, p in learnt(found).items() if p >= SURE)


def spans(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans: array of (kind, start, end, base)) for each row of df, base spans and added ones, by start and kind."""
    guarded(df.columns, [id_column, text], "pii")
    found = stored(candidates(df.select(id_column, text), text), "pii")
    sure = decided(found)
    keys = F.array(*(F.lit(f"{k}:{','.join(map(str, v))}") for k, v in sorted(sure))) if sure else F.array().cast("array<string>")
    keep = F.filter("found", lambda s: s["base"] | F.array_contains(keys, F.concat_ws(":", s["kind"], F.array_join(s["votes"].cast("array<string>"), ","))))
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))
    return found.select(id_column, F.transform(F.array_sort(F.transform(keep, order)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every base span and added span of the text replaced by its kind in angle brackets; overlapping ones by the first's."""
    guarded(df.columns, [text], "pii")
    sure = decided(stored(candidates(df.select(text), text), "pii"))
    position = df.columns.index(text)

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, position, BATCH_BYTES):
            texts = []
            for t in batch.column(position).to_pylist():
                base = base_spans(t or "")
                more = [s for s in (proposed(t, base) if t else ()) if (s[0], votes(t, *s, False)) in sure]
                out, end = [], 0
                for kind, a, b in sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]))):
                    if a >= end:
                        out += [t[end:a], f"<{kind.upper()}>"]
                    end = max(end, b)
                texts.append("".join([*out, t[end:]]) if out else t)
            columns = list(batch.columns)
            columns[position] = pa.array(texts, columns[position].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    named = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return named.mapInArrow(hide, named.schema).toDF(*df.columns)
