"""Mixing sources to target weights by hierarchical budgets.

The tree is domain, language, source. Going down, each node's budget is shared among its children by weight, a child never getting more than it can
supply in ``max_epochs`` epochs; what it cannot take goes to its siblings, and only what all of them cannot take goes to the siblings of an ancestor, since
an ancestor's supply is the sum of its leaves'. A leaf supplies whole epochs, then a prefix of the next, each in an order
of its own that the seed fixes. Where the prefix ends is found from sums over ranges of the order's hash and one short range of rows, so the rows
themselves are chosen where they are, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.llm.textcols import free_name, words_of
from slicewright.session import materialize

LEAF = ["domain", "lang", "source"]
#: Rows of a leaf in one range of its order, about.
RANGE_ROWS = 2000


@dataclass
class Plan:
    """Weights by level and value, whole numbers, 1 where none is given; ``budget`` in tokens, or a share of what there is."""

    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"lang": {"en": 4, "de": 2, "fr": 2, "es": 1}})
    budget: int | None = None
    budget_percent: int = 100
    max_epochs: int = 2
    seed: int = 17
    domains: int = 4


def domain_of(source: Column, domains: int) -> Column:
    """Where no catalog names a source's domain: its checksum deals it to one of ``domains``."""
    part = F.conv(F.substring(F.md5(source.cast("binary")), 1, 8), 16, 10).cast("long") % domains
    return F.concat(F.lit("domain"), part.cast("string"))


def place(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A row's place in the order of an epoch: 60 bits of a checksum of seed, epoch and id."""
    text = F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _keys(plan: Plan) -> dict[str, Column]:
    """The columns of a row's leaf, by the names of its levels."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"domain": domain_of(source, plan.domains), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source}


def _weight(plan: Plan, level: str) -> Column:
    out = F.lit(1)
    for value, weight in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(weight)).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, level: str, parent: list[str], plan: Plan) -> DataFrame:
    """``children`` have cap and up (the parent's budget); gives them give, their own."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("cap") / F.col("w"), level)
    rows = children.withColumn("w", _weight(plan, level)).withColumns(
        {"before": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), "after": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))}
    )
    rows = rows.withColumn("rate", F.max((F.col("up") - F.coalesce("before", F.lit(0))) / F.col("after")).over(group))
    return rows.withColumn("give", F.least(F.col("cap").cast("double"), F.col("w") * F.col("rate"))).drop("w", "before", "after", "rate", "up")


def budgets(rows: DataFrame, plan: Plan) -> DataFrame:
    """A row per leaf: domain, lang, source, tokens there are, rows, budget, whole epochs and what is left for the next.

    ``rows`` have domain, lang, source, n_tokens. One partial aggregation; all that follows works on the leaves.
    """
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")).where("tokens > 0").withColumn("cap", F.col("tokens") * plan.max_epochs)
    leaves = materialize(leaves, "leaves")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"))
    wanted = F.lit(plan.budget) if plan.budget is not None else F.floor(F.col("total") * plan.budget_percent / 100)
    top = leaves.agg(F.sum("tokens").alias("total"), F.sum("cap").alias("most")).select(F.least(wanted, F.col("most")).cast("double").alias("up"))
    d = _share(domains.crossJoin(F.broadcast(top)), "domain", [], plan)  # the other side is one row
    lang = _share(langs.join(d.select("domain", F.col("give").alias("up")), "domain"), "lang", ["domain"], plan)
    source = _share(leaves.join(lang.select("domain", "lang", F.col("give").alias("up")), ["domain", "lang"]), "source", ["domain", "lang"], plan)
    budget = F.floor(F.col("give") + F.lit(1e-6)).cast("long")
    out = source.select(*LEAF, "tokens", "n_rows", budget.alias("budget"))
    full = F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(plan.max_epochs)).cast("int")
    return out.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))


def thresholds(rows: DataFrame, leaves: DataFrame, plan: Plan) -> DataFrame:
    """``leaves`` with the last place (th, tid) of each one's prefix, null where there is none. ``rows`` have doc_id, the leaf and n_tokens."""
    ranges = F.ceil(F.col("n_rows") / RANGE_ROWS)
    ranged = rows.join(leaves.where("rest > 0").select(*LEAF, "full", "rest", "n_rows"), LEAF).withColumn("h", place(F.col("doc_id"), F.col("full"), plan.seed))
    ranged = ranged.withColumn("range", F.floor(F.col("h") / F.lit(float(1 << 60)) * ranges))
    sums = ranged.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("range")) - F.col("n")
    last = sums.withColumn("before", before).where("before < rest and before + n >= rest").select(*LEAF, "range", "before")
    end = ranged.join(last, [*LEAF, "range"])  # a row per leaf, whose measured size decides between broadcast and shuffle
    order = Window.partitionBy(*LEAF).orderBy(F.struct("h", "doc_id"))
    start = F.col("before") + F.sum("n_tokens").over(order) - F.sum("n_tokens").over(Window.partitionBy(*LEAF, "h", "doc_id"))
    within = end.withColumn("start", start).where("start < rest").groupBy(*LEAF).agg(F.max(F.struct("h", "doc_id")).alias("last"))
    return leaves.join(within, LEAF, "left")


def _plan_rows(docs: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    leaf = [c.alias(k) for k, c in _keys(plan).items()]
    return materialize(docs.select("doc_id", *leaf, F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("n_tokens")), "tokens")


def _epochs(full: str, last: str, doc_id: str, seed: int) -> Column:
    """The epochs in which a row is taken: all whole ones, and the next if it is in the prefix."""
    here = F.struct(place(F.col(doc_id), F.col(full), seed).alias("h"), F.col(doc_id).alias("doc_id"))
    count = F.col(full) + F.when(F.col(last).isNotNull() & (here <= F.col(last)), 1).otherwise(0)
    return F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)))


def mix(docs: DataFrame, plan: Plan | None = None, text: str = "text") -> DataFrame:
    """One row for each time that a document is taken: doc_id, domain, lang, source, epoch, n_tokens (words).

    Null lang and source count as empty names, null text as empty; leaves without words supply nothing. Rows with one id have one place in
    an order and go together. An empty table gives none.
    """
    plan = plan or Plan()
    rows = _plan_rows(docs, plan, text)
    leaves = materialize(thresholds(rows, materialize(budgets(rows, plan), "budgets"), plan).select(*LEAF, "full", "last"), "plan")
    taken = rows.join(leaves, LEAF)  # their measured size decides between broadcast and shuffle
    return taken.select("doc_id", *LEAF, _epochs("full", "last", "doc_id", plan.seed).alias("epoch"), "n_tokens")


def mix_documents(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The documents themselves, whole and with their own columns, once for each epoch that takes them."""
    plan = plan or Plan()
    rows = _plan_rows(docs, plan)
    names = {c: free_name(docs, f"leaf_{c}") for c in [*LEAF, "full", "last", "epoch"]}
    leaves = thresholds(rows, materialize(budgets(rows, plan), "budgets"), plan).select(*[F.col(c).alias(names[c]) for c in [*LEAF, "full", "last"]])
    taken = docs.withColumns({names[k]: c for k, c in _keys(plan).items()}).join(materialize(leaves, "plan"), [names[c] for c in LEAF])
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], _epochs(names["full"], names["last"], "doc_id", plan.seed).alias(names["epoch"])).drop(names["epoch"])


def _oracle(plan: Plan) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"when '{v}' then {w}" for v, w in plan.weights.get(level, {}).items())
        return f"(case {level} {cases} else 1 end)" if cases else "1"

    def share(name: str, children: str, level: str, parent: str) -> str:
        part = f"partition by {parent}" if parent else ""
        return f"""{name}_w as (select *, {weight(level)} as w from ({children})),
{name}_s as (select *, (up - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (o rows between current row and unbounded following) as r from {name}_w window o as ({part} order by cap / w, {level})),
{name} as (select *, least(cap, w * max(r) over ({part})) as give from {name}_s),
"""

    return f"""
with d as (select doc_id, 'domain' || (('0x' || substr(md5(coalesce(source, '')), 1, 8))::bigint % {plan.domains}) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
l as (select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {plan.max_epochs})::bigint as cap from d group by all having sum(n_tokens) > 0),
{share("a", f"select domain, sum(cap)::bigint as cap, (select least(floor(sum(tokens) * {plan.budget_percent} / 100), sum(cap))::double from l) as up from l group by domain", "domain", "")}
{share("b", "select l.domain, lang, sum(l.cap)::bigint as cap, any_value(a.give) as up from l join a on l.domain = a.domain group by l.domain, lang", "lang", "domain")}
{share("c", "select l.*, b.give as up from l join b on l.domain = b.domain and l.lang = b.lang", "source", "domain, lang")}
p as (select domain, lang, source, tokens, floor(give + 1e-6)::bigint as budget from c),
q as (select *, least(budget // tokens, {plan.max_epochs})::int as whole, budget - least(budget // tokens, {plan.max_epochs}) * tokens as rest from p),
h as (select d.*, whole, rest, ('0x' || substr(md5('{plan.seed}/' || whole || '/' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from d join q using (domain, lang, source)),
s as (select *, sum(n_tokens) over (partition by domain, lang, source order by h, doc_id) - n_tokens as start from h)
select doc_id, domain, lang, source, e.epoch::int as epoch, n_tokens from s, (select unnest(range(0, {plan.max_epochs + 1})) as epoch) e
where e.epoch < whole or e.epoch = whole and start < rest
"""


ORACLE = _oracle(Plan())
