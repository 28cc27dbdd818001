"""Scalar functions on columns; all stay inside code generation."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers that name the time column, words of headers that name the run column, and phrasings of cause (fixed values).
TIME_HEADERS = ("time", "time (h)", "time(h)", "time_h", "time [h]", "elapsed_time", "elapsed time", "t")
RUN_TOKENS = ("batch_ref", "batch", "batch_id", "run", "run_id", "run_ref", "experiment_run", "trial")
CAUSAL_PHRASES = ("because", "due to", "caused by", "resulted in", "leading to")
#: File names that hold a run number, in the order of trial (fixed values).
FILE_RUNS = (r"(?i)(?:^|[^A-Za-z0-9])(?:run|batch|exp|experiment|trial)[-_]?(\d+)(?:$|[^A-Za-z0-9])", r"(?:^|_)R(\d+)(?:$|_|\.)", r"(?:^|_)B(\d+)(?:$|_|\.)")
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
CAUSAL = r"(?i)\b(" + "|".join(CAUSAL_PHRASES) + r")\b"


def normalize_header(h: Column) -> Column:
    """Text before a parenthesis or bracket that closes, without a colon at its end, in lower case."""
    h = F.when(h.contains("(") & h.contains(")"), F.substring_index(h, "(", 1)).otherwise(h)
    h = F.when(h.contains("[") & h.contains("]"), F.substring_index(h, "[", 1)).otherwise(h)
    return F.lower(F.trim(F.regexp_replace(F.trim(h), ":+$", "")))


def extract_unit(h: Column) -> Column:
    """Text from the first ``(`` to the last ``)``, else between brackets; null if blank."""
    round_, square = (F.nullif(F.trim(F.regexp_extract(h, p, 1)), F.lit("")) for p in (r"\((.*)\)", r"\[(.*)\]"))
    return F.when(h.rlike(r"\(.*\)"), round_).otherwise(square)


def numeric(s: Column) -> Column:
    """A double, null if the text is no plain decimal number."""
    return F.when(s.rlike(NUMERIC), F.trim(s).try_cast("double"))


def finite(x: Column) -> Column:
    """The number, null for nan and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def hours(s: Column) -> Column:
    """A time in hours, null if the text is no finite number."""
    return finite(numeric(s))


def empty_cell(s: Column) -> Column:
    return s.isNull() | F.lower(F.trim(s)).isin("", "nan")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "auto").when(c >= 0.60, "needs_review").otherwise("residual")


def coerce_value(s: Column, kind: Column) -> Column:
    """Text of the value as its declared type has it; the raw text where it can't be read so."""
    x = numeric(s)
    whole = F.when((x == F.floor(x)) | x.isNotNull(), x.cast("bigint").cast("string"))
    return F.coalesce(F.when(kind == "int", whole).when(kind == "bool", F.lower(F.trim(s)).isin("true", "yes", "1").cast("string")), s)


def extraction_confidence(s: Column, kind: Column) -> Column:
    return F.when(kind.isin("float", "int") & numeric(s).isNull(), 0.5).otherwise(1.0)


def run_id(s: Column) -> Column:
    """``RUN-0007`` for whole numbers, the trimmed text otherwise, null for blank and nan."""
    x = numeric(s)
    whole = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.format_string("RUN-%04d", x.cast("bigint")))
    return F.when(~empty_cell(s), F.coalesce(whole, F.trim(s)))


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")


def run_from_filename(name: Column) -> Column:
    """The number of the first pattern that fits the file's stem, as a run id."""
    found = [F.nullif(F.regexp_extract(_stem(name), p, 1), F.lit("")) for p in FILE_RUNS]
    number = F.coalesce(*found).try_cast("bigint")
    return F.when(number.isNotNull(), F.format_string("RUN-%04d", number))


def synthetic_run(name: Column) -> Column:
    stem = F.substring(F.regexp_replace(_stem(name), "[^A-Za-z0-9_-]", "_"), 1, 40)
    return F.coalesce(F.concat(F.lit("RUN-FROM-"), F.coalesce(F.nullif(stem, F.lit("")), F.when(name.isNotNull() & (name != ""), "FILE"))), F.lit("RUN-UNKNOWN"))


def is_time_header(h: Column) -> Column:
    return F.lower(F.trim(h)).isin(*TIME_HEADERS)


def values_match(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= tolerance


def evidence_verdict(evidence: Column, source: Column, forms: Column) -> Column:
    """``ok`` or the first reason against a quotation of ``source``; ``forms`` are spellings of its value, null if it has none."""
    ends = F.length(F.regexp_replace(evidence, "[^.!?]", ""))
    return (
        F.when(F.coalesce(F.trim(evidence) == "", F.lit(True)), "empty")
        .when(F.length(evidence) > 200, "too_long")
        .when(~F.coalesce(source.contains(evidence), F.lit(False)), "not_in_source")
        .when(forms.isNotNull() & ~F.exists(forms, lambda f: evidence.contains(f)), "value_missing")
        .when(ends > 2, "too_many_sentences")
        .otherwise("ok")
    )


def block_class(label: Column) -> Column:
    label = F.lower(label)
    return F.when(label.contains("head") | label.contains("title"), "heading").when(label.contains("list") | label.contains("item"), "list_item").when(label.contains("caption"), "caption").when(label.contains("text") | label.contains("paragraph"), "paragraph").otherwise("other")


def clamp(c: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.85), F.coalesce(numeric(c), F.lit(default))))


def causal_phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CAUSAL), F.lit(1))


def id_kind(s: Column) -> Column:
    """What an id stands for, by its shape; null if it has none of the known ones."""
    known = ((r"^F-\d{4,}$", "finding"), (r"^N-\d{4,}$", "narrative"), (r"^T-\d{4,}$", "trajectory"), (r"^E-\d{4,}$", "event"), (r"^Q-\d{4,}$", "question"), (r"^D-[FTAQ]-\d{4,}$", "claim"), (r"^D-\d{4,}$", "deviation"))
    return F.coalesce(*(F.when(s.rlike(shape), name) for shape, name in known))


def sampling_hint(variable: Column) -> Column:
    return F.concat(F.lit("finer_"), variable, F.lit("_sampling"))


def organism_matches(query: Column, name: Column) -> Column:
    query, name = F.lower(query), F.lower(name)
    return name.contains(query) | query.contains(name)


def severity_rank(sigmas: Column) -> Column:
    """0 within spec, then 1 minor, 2 major, 3 critical, by the absolute number of standard deviations."""
    s = F.abs(sigmas)
    return F.when(s < 2, 0).when(s < 3, 1).when(s < 5, 2).otherwise(3)


def severity(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("info", "minor", "major", "critical"))), rank + 1)


def severity_confidence(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (0.6, 0.85, 0.95, 0.99))), rank + 1)


def value_forms(value: Column) -> Column:
    """Spellings of a number that a quotation of it may use; null for null."""
    x = numeric(value)
    whole = F.when(x == F.floor(x), x.cast("bigint").cast("string"))
    return F.when(value.isNotNull(), F.array_compact(F.array_distinct(F.array(F.trim(value), x.cast("string"), whole, *(F.format_string(f"%.{k}f", x) for k in (1, 2, 3))))))


def magnitude(x: Column) -> Column:
    """Grows by at most 1.0011e-3 between values that match to 1e-3: the value up to 1, its logarithm beyond."""
    a = F.abs(x)
    return F.signum(x) * F.when(a <= 1, a).otherwise(1 + F.ln(a))


def confidence_basis(basis: Column) -> Column:
    return F.when(basis.isin("process_priors", "schema_only", "cross_run"), basis).otherwise("schema_only")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is written and evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _two_product(a: Column, b: Column) -> Column:
    """The product as a double (p), and what it lacks of the exact one (e)."""
    split = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)
    parts = F.struct(a.alias("a"), b.alias("b"), (a * b).alias("p"), split(a).alias("x"), split(b).alias("y"))
    return let(parts, lambda t: F.struct(t["p"].alias("p"), (((t["x"] * t["y"] - t["p"]) + t["x"] * (t["b"] - t["y"]) + (t["a"] - t["x"]) * t["y"]) + (t["a"] - t["x"]) * (t["b"] - t["y"])).alias("e")))


def _far_powers() -> tuple[list[float], list[float], list[float]]:
    """10**q from -340 to 320 as the sum of two doubles, and the power of two that these are scaled by to stay in range."""
    out: tuple[list[float], list[float], list[float]] = ([], [], [])
    for q in range(-340, 321):
        shift = -600 if q > 150 else 600 if q < -150 else 0
        exact = Fraction(10) ** q * Fraction(2) ** shift
        for column, x in zip(out, (float(exact), float(exact - Fraction(float(exact))), 2.0**shift), strict=True):
            column.append(x)
    return out


def _six_digits(m: Column) -> Column:
    """Six digits (k) and the decimal exponent (e) of a positive number."""
    text = lambda t: F.struct(F.replace(F.substring_index(t, "e", 1), F.lit("."), F.lit("")).cast("int").alias("digit"), F.substring_index(t, "e", -1).cast("int").alias("power"))
    # Rounded up from a half of the shortest decimal, which may lie above the exact value: compared exactly with that half.
    lower = lambda s: F.struct(s["digit"], s["power"], F.when(s["digit"] == 100_000, 999_999).otherwise(s["digit"] - 1).alias("down"), F.when(s["digit"] == 100_000, s["power"] - 1).otherwise(s["power"]).alias("below"))
    tens = lambda q: F.pow(F.lit(10.0), F.least(F.greatest(q, F.lit(0)), F.lit(22)))

    def choose(s: Column) -> Column:
        half, q = (2 * s["down"] + 1).cast("double"), s["below"] - 5
        high, low, shift = (F.get(F.array(*map(F.lit, c)), q + 340) for c in _far_powers())
        far = let(F.struct(_two_product(half, high).alias("t"), low.alias("low"), (2 * (m * shift)).alias("own")), lambda t: ((t["own"] - t["t"]["p"]) - t["t"]["e"]) - half * t["low"])
        up = let(_two_product(half, tens(q)), lambda t: (2 * m - t["p"]) - t["e"])
        under = let(_two_product(2 * m, tens(-q)), lambda t: (t["p"] - half) + t["e"])
        gap = F.when(F.abs(q) > 22, far).when(q >= 0, up).otherwise(under)
        down = let(gap, lambda g: (g < 0) | ((g == 0) & (s["down"] % 2 == 0)))
        return let(down, lambda d: F.struct(F.when(d, s["down"]).otherwise(s["digit"]).cast("string").alias("k"), F.when(d, s["below"]).otherwise(s["power"]).alias("e")))

    return let(let(let(F.format_string("%.5e", m), text), lower), choose)


def fmt_g(x: Column) -> Column:
    """Six significant digits without zeros at the end; an exponent below 1e-4 and from 1e6 on.

    Digits are those of the exact value, a half goes to the even digit; numbers below 2.3e-308 have fewer digits.
    """
    short = lambda t: F.regexp_replace(t, r"\.?0*$", "")

    def spelt(s: Column) -> Column:
        k, e = s["k"], s["e"]
        plain = F.when(e >= 0, F.concat(F.substr(k, F.lit(1), e + 1), F.lit("."), F.substr(k, e + 2, F.lit(6)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), k))
        tall = F.concat(short(F.concat(F.substring(k, 1, 1), F.lit("."), F.substring(k, 2, 5))), F.format_string("e%+03d", e))
        return F.when(e.between(-4, 5), short(plain)).otherwise(tall)

    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    body = lambda m: F.when(m == 0, "0").when(m == float("inf"), "inf").otherwise(let(_six_digits(m), spelt))
    return F.when(F.isnan(x), "nan").otherwise(F.concat(sign, let(F.abs(x), body)))


def millionths(x: Column) -> Column:
    """The number in whole millionths, which sums don't round; null if it isn't finite or beyond 1e32."""
    return F.round(x * 1e6).try_cast("decimal(38,0)")


def ratio_half_up(a: Column, b: Column) -> Column:
    """The whole number nearest to ``a / b`` of whole numbers, b positive, halves away from zero; it must fit a long."""
    return F.signum(a.cast("double")).cast("long") * F.call_function("div", 2 * F.abs(a) + b, 2 * b)


def finding_text(variable: Column, run: Column, value: Column, sigmas: Column) -> Column:
    return F.concat(variable, F.lit(" in "), run, F.lit(": "), fmt_g(value), F.lit(", "), fmt_g(F.abs(sigmas)), F.lit(" standard deviations off"))


def first_filled(*texts: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(t), F.lit("")) for t in texts))


def caveat_text(pct_imputed: Column) -> Column:
    """What a finding on a thinly sampled series is told with."""
    return F.concat(F.bround(pct_imputed * 100).cast("int").cast("string"), F.lit("% of the series is carried forward"))


def question_text(variable: Column, run: Column, pct_imputed: Column) -> Column:
    return F.concat(F.lit("Is "), variable, F.lit(" in "), run, F.lit(" as it seems, with "), F.bround(pct_imputed * 100).cast("int").cast("string"), F.lit("% carried forward?"))
