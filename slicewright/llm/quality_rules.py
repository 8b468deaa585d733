"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). There are at most 3^6 vote patterns, counted over all rows by one partial
aggregation; expectation-maximisation over those counts estimates the prior and, for each rule, how often it is
right on good and on bad texts. A text is kept if its posterior probability of being good is at least one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.llm.textcols import SPACES, words_of

#: Rules in order: (name, good if, bad if) as SQL over the statistics; else it abstains.
RULES = [
    ("symbols", "100 * n_symbols <= 2 * n_words", "100 * n_symbols > 10 * n_words"),
    ("repeats", "100 * n_repeat_words <= 4 * n_words", "100 * n_repeat_words > 12 * n_words"),
    ("lines", "n_dup_lines = 0", "3 * n_dup_lines > n_lines"),
    ("shouting", "100 * n_capitals <= 12 * n_bytes", "100 * n_capitals > 35 * n_bytes"),
    ("word_length", "10 * word_chars between 30 * n_words and 90 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("length", "n_words >= 20", "n_words < 10"),
]
NAMES = [name for name, _, _ in RULES]
ROUNDS = 12
#: Starting accuracies, and the count that holds each estimate away from 0 and 1.
START, SMOOTH = 0.8, 1.0
#: A rule does better than chance: the least accuracy that is believed.
FLOOR = 0.55


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_bytes.

    Null text counts as empty, with zero everywhere; whole texts are read, and no other column is.
    """
    whole = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    lines = F.filter(F.split("__t", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    cut = whole.select("__id", "__t", words_of(F.col("__t")).alias("__w"), lines.alias("__l"))
    counted = cut.select(
        "__id",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.length("__t") - F.length(F.regexp_replace("__t", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        F.octet_length("__t").cast("long").alias("n_bytes"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    n = F.col("n_words").cast("int") - 4
    zipped = F.arrays_zip(*[F.slice("__h", k, n).alias(f"w{k}") for k in range(1, 6)])
    grams = F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.transform(zipped, lambda g: F.xxhash64(g)))
    with_grams = counted.select(*[c for c in counted.columns if c != "__h"], grams.alias("__g"))
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    pairs = F.when(some, F.sort_array(F.arrays_zip(F.col("__g").alias("g"), F.sequence(F.lit(0), F.size("__g") - 1).alias("p"))))
    ordered = with_grams.select(*[c for c in with_grams.columns if c != "__g"], pairs.alias("__s"))
    twice = F.filter("__s", lambda x, i: (F.get("__s", i - 1)["g"] == x["g"]) | (F.get("__s", i + 1)["g"] == x["g"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
    placed = ordered.select(*[c for c in ordered.columns if c != "__s"], starts.alias("__p"))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("__p", nothing, lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n"), (p + 5).alias("end")), lambda a: a["n"])
    return placed.select(F.col("__id").alias(doc_id), *[c for c in placed.columns if c not in ("__id", "__p")], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def votes(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"v_{name}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for name, good, bad in RULES})


def _log_odds(model: dict[str, float]) -> Column:
    """Of good against bad, given the votes and each rule's two accuracies."""
    total = F.lit(0.0) + F.log(F.lit(model["prior"] / (1 - model["prior"])))
    for name in NAMES:
        good, bad = model[f"good_{name}"], model[f"bad_{name}"]
        total += F.when(F.col(f"v_{name}") == 1, F.log(F.lit(good / (1 - bad)))).when(F.col(f"v_{name}") == -1, F.log(F.lit((1 - good) / bad))).otherwise(0.0)
    return total


def posterior(model: dict[str, float]) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(model)))


def fit(voted: DataFrame) -> dict[str, float]:
    """Expectation-maximisation over the counts of vote patterns, of which there are at most 3^rules."""
    spark = voted.sparkSession
    columns = [f"v_{name}" for name in NAMES]
    counts = voted.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()
    model = {"prior": START} | {f"{side}_{name}": START for name in NAMES for side in ("good", "bad")}
    if not counts:
        return model
    values = ", ".join("(" + ", ".join(str(x) for x in row) + ")" for row in counts)
    patterns = spark.sql(f"select * from values {values} as t({', '.join([*columns, 'n'])})")
    for _ in range(ROUNDS):
        p, n = posterior(model), F.col("n")
        sums = {"good": F.sum(n * p), "all": F.sum(n)}
        for name in NAMES:
            v = F.col(f"v_{name}")
            sums |= {f"{name}_gp": F.sum(F.when(v == 1, n * p).otherwise(0.0)), f"{name}_g": F.sum(F.when(v != 0, n * p).otherwise(0.0))}
            sums |= {f"{name}_bn": F.sum(F.when(v == -1, n * (1 - p)).otherwise(0.0)), f"{name}_b": F.sum(F.when(v != 0, n * (1 - p)).otherwise(0.0))}
        got = patterns.agg(*[value.alias(key) for key, value in sums.items()]).first()
        model = {"prior": (got["good"] + SMOOTH) / (got["all"] + 2 * SMOOTH)}
        for name in NAMES:
            for side, right, seen in (("good", "gp", "g"), ("bad", "bn", "b")):
                share = (got[f"{name}_{right}"] + SMOOTH * START) / (got[f"{name}_{seen}"] + SMOOTH)
                model[f"{side}_{name}"] = min(max(share, FLOOR), 0.999)
    return model


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, good_probability and kept.

    ``kept`` is false for texts that fail the base rule, else whether the posterior is at least one half. Null and empty texts fail the base rule.
    Repeated rows are judged alike; an empty table gives none.
    """
    from slicewright.session import materialize

    voted = materialize(votes(statistics(docs, doc_id, text)), "votes")
    model = fit(voted)
    judged = voted.withColumns({"base_failed": F.expr(BASE_FAILED), "good_probability": posterior(model)})
    kept = ~F.col("base_failed") & (F.col("good_probability") >= 0.5)
    return judged.select(doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def _oracle() -> str:
    """The same in SQL: the rounds are unrolled, one row of the model for each."""
    stats = """
with recursive t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
g as (select doc_id, i, list_slice(w, i, i + 4) as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
r as (select doc_id, count(distinct i + k) as n from d, (select unnest(range(0, 5)) as k) group by doc_id),
s as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
 len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
 coalesce(r.n, 0)::bigint as n_repeat_words, len(l) as n_lines, len(regexp_extract_all(t, '[A-Z]')) as n_capitals, strlen(t) as n_bytes
 from w left join r on w.doc_id = r.doc_id),
"""
    cases = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as v_{name}" for name, good, bad in RULES)
    pattern = ", ".join(f"v_{name}" for name in NAMES)
    start = ", ".join([f"{START}::double as prior", *[f"{START}::double as {side}_{name}" for name in NAMES for side in ("good", "bad")]])
    odds = "ln(prior / (1 - prior))" + "".join(f" + case v_{n} when 1 then ln(good_{n} / (1 - bad_{n})) when -1 then ln((1 - good_{n}) / bad_{n}) else 0 end" for n in NAMES)
    parts = [stats, f"v as materialized (select *, {cases} from s),\nc as materialized (select {pattern}, count(*) as n from v group by all),\nm0 as materialized (select {start})"]
    for k in range(ROUNDS):
        step = [f"(sum(n * p) + {SMOOTH}) / (sum(n) + {2 * SMOOTH}) as prior"]
        for name in NAMES:
            for side, vote, p in (("good", 1, "p"), ("bad", -1, "(1 - p)")):
                step.append(f"least(greatest((coalesce(sum(n * {p}) filter (v_{name} = {vote}), 0) + {SMOOTH * START}) / (coalesce(sum(n * {p}) filter (v_{name} <> 0), 0) + {SMOOTH}), {FLOOR}), 0.999) as {side}_{name}")
        parts.append(f",\nm{k + 1} as materialized (select {', '.join(step)} from (select c.*, 1 / (1 + exp(-({odds}))) as p from c, m{k}))")
    parts.append(f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) as base_failed, not ({BASE_FAILED}) and 1 / (1 + exp(-({odds}))) >= 0.5 as kept from v, m{ROUNDS}")
    return "".join(parts)


ORACLE = _oracle()
