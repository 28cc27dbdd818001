"""Personal data: fixed formats, and more of it by bootstrapped contextual extraction.

The fixed formats (email, ip, card, phone) give base spans. These are also the seeds of a bootstrap: every seed, and every
loosely similar string that no format accepts, is an *instance* that stands in lexical patterns (the word before, the two
words before, the words on both sides). Spark scores the graph of patterns and instances in rounds: a pattern is as good as what
its instances say for the kind against what they say for another or against the kind (unknown ones say nothing), an instance as good as its patterns together make it.
Instances that end above the threshold become further spans of that kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm.common import discard, materialise, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A pattern's words are those that end within so many characters before an instance, or begin within so many after it: a word that
#: goes on beyond is cut there. Blanks of such a length leave no word, and an instance without a word before has no pattern.
BEFORE, AFTER = 80, 40
#: Characters on each side of an ``@`` that a loose address may have; what is longer is cut.
REACH = 64
#: Loose forms of each kind, candidates for the bootstrap only: addresses with ``@`` or a spelt one (parts of up to 64 characters),
#: numbers of 7 to 31 characters, groups of hexadecimal digits. Longer strings are no identifiers and no candidates.
NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9().\x20/-]{5,28}[0-9](?![0-9A-Za-z])")
ADDRESS6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,64}){1,6}")
DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([/.-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([/.-])(?:0?[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2})(?![0-9])")
SPAN = "struct<kind:int,start:int,end:int>"
FOUND = "array<struct<kind:int,start:int,end:int,seed:boolean,doubt:boolean,value:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        own = LOCAL.match(text[free:at][::-1])
        host = DOMAIN.match(text, at + 1) if own else None
        if host:
            yield at - own.end(), host.end()
            free = host.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def _loose(text: str) -> Iterator[tuple[int, int, int]]:
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a and at - a < REACH and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b - at < REACH and not text[b].isspace():
            b += 1
        if b - at > 2 and at - a > 0:
            yield 0, a, b
        at = text.find("@", b)
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        for m in SPELT.finditer(text):
            yield 0, m.start(), m.end()
    if text.count(":") > 2:
        for m in ADDRESS6.finditer(text):
            yield 1, m.start(), m.end()
    for m in NUMBER.finditer(text):
        n = len(re.sub("[^0-9]", "", m[0]))
        if 12 <= n <= 19:
            yield 2, m.start(), m.end()
        if 7 <= n <= 15:
            yield 3, m.start(), m.end()


def _patterns(text: str, start: int, end: int) -> list[str]:
    before = re.sub("[0-9]", "0", text[max(0, start - BEFORE) : start].lower()).split()[-2:]
    after = re.sub("[0-9]", "0", text[end : end + AFTER].lower()).split()[:1]
    if not before:
        return []
    out = [f"L {before[-1]}"]
    if len(before) > 1:
        out.append(f"LL {before[0]} {before[1]}")
    if after:
        out.append(f"LR {before[-1]} _ {after[0]}")
    return out


def _doubt(kind: int, value: str) -> bool:
    """The form speaks against the kind: a card number of a wrong check digit, a phone number that is a date."""
    return not luhn(re.sub("[^0-9]", "", value)) if kind == 2 else kind == 3 and DATE.match(value) is not None


def _instances(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    out = [{"kind": k, "start": a, "end": b, "seed": True, "doubt": False, "value": text[a:b], "patterns": _patterns(text, a, b)} for k, a, b in base]
    if "@" in text or re.search("[0-9]|[(\\[](?:at|AT)", text):
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken])
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        for k, a, b in _loose(text):
            i = np.searchsorted(starts, b) if taken else 0
            if not i or reach[i - 1] <= a:
                out.append({"kind": k, "start": a, "end": b, "seed": False, "doubt": _doubt(k, text[a:b]), "value": text[a:b], "patterns": _patterns(text, a, b)})
    return out


def extract(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, th, base, found`` of ``docs(doc_id, text)``; th is a 128-bit digest of the text."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            base = [base_spans(t) if t else [] for t in part["text"]]
            found = [_instances(t, b) if t else [] for t, b in zip(part["text"], base, strict=True)]
            spans = [[{"kind": k, "start": a, "end": e} for k, a, e in b] for b in base]
            yield pd.DataFrame({"rid": part["rid"], "doc_id": part["doc_id"], "th": part["th"], "base": spans, "found": found})

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.md5("text").alias("th"), "text")
    return numbered.mapInPandas(scan, f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, th string, base array<{SPAN}>, found {FOUND}")


def bootstrap(instances: DataFrame, rounds: int = 3, least_seeds: int = 5, confidence: float = 0.8) -> DataFrame:
    """``kind, value, score`` of the instances (kind, value, seed, doubt, patterns) that trusted patterns discover.

    A pattern counts for a kind from ``least_seeds`` distinct seeds on. Its score is the sum of its instances' scores over
    one more than that sum and the instances against it: seeds of another kind, ones discovered as another kind, and ones
    whose form speaks against the kind (``doubt``). Unknown instances are neutral.
    """
    kinds = range(len(KINDS))
    edges = instances.select("kind", "value", "seed", "doubt", F.explode("patterns").alias("pattern")).groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed"), F.max("doubt").alias("doubt"))
    edges = materialise(edges, "pattern-edges")
    pairs = edges.groupBy("pattern", "value").agg(*(F.max((F.col("kind") == k) & F.col(x)).alias(f"{x}{k}") for k in kinds for x in ("seed", "doubt")))
    usable = pairs.groupBy("pattern").agg(*(F.count_if(f"seed{k}").alias(f"seeds{k}") for k in kinds))
    usable = materialise(usable.where(F.greatest(*(f"seeds{k}" for k in kinds)) >= least_seeds), "patterns")
    pairs = materialise(pairs.join(usable.select("pattern"), "pattern"), "pattern-graph")
    unseen = materialise(edges.where("not seed").select("kind", "value", "pattern").join(usable.select("pattern"), "pattern"), "pattern-unseen")
    known = unseen.where("false").select("kind", "value", F.lit(0.0).alias("score"))
    spent: list[DataFrame] = []
    for _ in range(rounds):
        scores = known.groupBy("value").agg(*(F.max(F.when(F.col("kind") == k, F.col("score"))).alias(f"score{k}") for k in kinds))
        own = [F.when(F.col(f"seed{k}"), 1.0).when(F.col(f"doubt{k}"), 0.0).otherwise(F.coalesce(f"score{k}", F.lit(0.0))) for k in kinds]
        against = [F.greatest((F.col(f"doubt{k}") & ~F.col(f"seed{k}")).cast("double"), *(own[j] for j in kinds if j != k)) for k in kinds]
        sums = pairs.join(scores, "value", "left").groupBy("pattern").agg(*(F.sum(own[k]).alias(f"for{k}") for k in kinds), *(F.sum(against[k]).alias(f"against{k}") for k in kinds))
        conf = [F.when(F.col(f"seeds{k}") >= least_seeds, F.col(f"for{k}") / (F.col(f"for{k}") + F.col(f"against{k}") + 1)) for k in kinds]
        patterns = sums.join(usable, "pattern").select("pattern", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), conf[k].alias("conf")) for k in kinds))))
        patterns = materialise(patterns.where(F.col("conf") >= confidence), "trusted-patterns")
        known = unseen.join(patterns, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        last = materialise(known, "known-instances")
        discard(patterns, *spent)
        known, spent = last, [last]
    discard(edges, usable, pairs, unseen)
    return known.where(F.col("score") >= confidence)


def find(docs: DataFrame, **options: float) -> DataFrame:
    """``doc_id, th, base, more, spans`` for each row of ``docs(doc_id, text)``; spans are (kind, start, end) in code points.

    ``base`` has the spans of the fixed formats, ``more`` the discovered ones, ``spans`` both, by kind and start. Null texts are
    empty and hold none. Repeated rows stay, with equal spans; nulls in doc_id stay; further columns are ignored; an empty
    table gives an empty table.
    """
    rows = materialise(extract(docs), "instances")
    flat = rows.select("rid", F.explode("found").alias("i")).select("rid", "i.*")
    known = bootstrap(flat, **options)
    more = flat.where("not seed").join(known, ["kind", "value"]).groupBy("rid", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    more = more.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    none = F.array().cast(f"array<{SPAN}>")
    out = rows.drop("found").join(more, "rid", "left").withColumn("more", F.coalesce("more", none))
    return out.select("doc_id", "th", "base", "more", F.array_sort(F.concat("base", "more")).alias("spans"))


def _listed(spans: str) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in square brackets; overlapping spans as one, by the first's.

    All columns stay, whatever their names, and so do all rows, repeated ones too. Null texts stay null, empty ones empty; a
    very long text is masked whole, in one row of one task. An empty table gives an empty table. A text's own spans are found
    where it is; only the discovered ones are joined, by a 128-bit digest of their text.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, more, strict=True):
            own = [(a, -b, k) for k, a, b in base_spans(text)] if text else []
            own += [(s["start"], -s["end"], s["kind"]) for s in found] if found is not None else []
            if own:
                parts, done = [], 0
                for start, end, kind in sorted(own):
                    if start >= done:
                        parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
                    done = max(done, -end)
                text = "".join([*parts, text[done:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    spans = find(docs).where("size(more) > 0").groupBy("th").agg(F.first("more").alias("__spans"))
    spans = materialise(spans, "spans").withColumnRenamed("th", "__th")
    marked = docs.join(spans, F.md5(docs["text"]) == spans["__th"], "left")
    return marked.select(*(docs[c] if c != "text" else mask(docs["text"], spans["__spans"]).alias("text") for c in docs.columns))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
