"""Ranked search over named entries: an inverted index of tokens, then a rank by several features in a fixed order.

Entries are (name, description), queries (query, text). Tokens are what blanks and ``- _ / . :`` leave, in lower case; one
matches another if they are equal or one is the other's plural (``s``, or ``ies`` for ``y``). An entry is found if its name holds the query
as a phrase, or any of its tokens matches one, or its description contains one. Better entries have, in this order: the
query as their name; a rank as the apply step that the query asks for; the phrase in their name; more query tokens in their name; a rank as the plan step of
an apply step; query tokens closer together and in order; more query tokens in their description; the smaller name.

Names and terms meet by keys: a token and its singular forms, and for parts of tokens the runs of three characters in them.
Entries that no term tells apart are compared as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.lineage import checkpointed

#: At most so many results are given.
MOST = 12
FEATURES = ("exact", "explicit", "phrase", "name_hits", "safety", "distance")


def search_tokens(text: Column) -> Column:
    """Lower-case tokens of a text in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \-_/.:]+"), lambda x: F.trim(x) != "")


def stems(token: Column) -> Column:
    """Keys of a token, of which two that match share one: itself and what it may be the plural of."""
    return F.array_distinct(F.filter(F.array(
        token, F.when(F.endswith(token, F.lit("s")), F.regexp_replace(token, "s$", "")), F.when(F.endswith(token, F.lit("ies")), F.regexp_replace(token, "ies$", "y")),
    ), lambda x: x.isNotNull()))


def same_token(a: Column, b: Column) -> Column:
    """Whether two tokens are equal or one is the other's plural."""
    s, ies = F.lit("s"), F.lit("ies")
    plural = lambda x, y: (y == F.concat(x, s)) | (F.endswith(x, F.lit("y")) & (y == F.concat(F.regexp_replace(x, "y$", ""), ies)))
    return (a == b) | plural(a, b) | plural(b, a)


def _runs(token: Column, n: int = 3) -> Column:
    """The runs of up to ``n`` characters in a token."""
    at = F.sequence(F.lit(1), F.length(token))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.length(token) - i + 1)), lambda k: F.substring(token, i, k)))))


def distance(name: Column, terms: Column) -> Column:
    """How far apart and out of order the terms stand in a name: gaps count a hundred each, missing ones ten thousand."""
    start = F.struct(F.lit(0).alias("matched"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("at"))

    def step(s, token):
        hit = F.coalesce(same_token(token, F.get(terms, s["matched"])), F.lit(False))
        return F.struct(
            F.when(hit, s["matched"] + 1).otherwise(s["matched"]).alias("matched"), F.when(hit & (s["first"] < 0), s["at"]).otherwise(s["first"]).alias("first"),
            F.when(hit, s["at"]).otherwise(s["last"]).alias("last"), (s["at"] + 1).alias("at"),
        )

    n, m = F.size(name), F.size(terms)
    return F.aggregate(name, start, step, lambda s: F.when(s["matched"] < m, 10_000 + n - F.least(n, s["matched"])).otherwise((s["last"] - s["first"] + 1 - m) * 100 + F.abs(n - m)))


def workflow(entries: DataFrame) -> DataFrame:
    """Entries with ``plans`` and ``applies``: whether they are the plan step, or the apply step, of a pair of entries."""
    names = entries.select(F.col("name").alias("_other"), F.lit(True).alias("_found")).distinct()
    rest = lambda prefix: F.when(F.startswith("name", F.lit(prefix)), F.substring("name", F.lit(len(prefix) + 1), F.length("name")))
    plan, apply = rest("plan_"), rest("apply_")
    wanted = [
        ("p1", F.concat(F.lit("apply_"), plan)), ("p2", F.when(F.endswith(plan, F.lit("_apply")), F.concat(F.lit("apply_"), F.regexp_replace(plan, "_apply$", "")))),
        ("a1", F.concat(F.lit("plan_"), apply)), ("a2", F.concat(F.lit("plan_"), apply, F.lit("_apply"))),
    ]
    out = entries
    for flag, other in wanted:
        out = out.withColumn("_want", other).join(names, F.col("_want") == F.col("_other"), "left").withColumn(flag, F.coalesce("_found", F.lit(False))).drop("_want", "_other", "_found")
    return out.withColumns({"plans": F.col("p1") | F.col("p2"), "applies": F.col("a1") | F.col("a2")}).drop("p1", "p2", "a1", "a2")


def _token_facts(tokens: DataFrame, lists: DataFrame) -> DataFrame:
    """(token, how, term): all that decides how a name's token meets the lists' terms; it is equal, a plural, begins, ends or holds a term.

    Beginnings matter for last terms, ends for first ones, and what is inside for terms that stand alone, as a phrase takes whole tokens between.
    """
    one, t = F.size("terms") == 1, F.col("token")
    term = lists.select(F.explode("terms").alias("term")).distinct()
    keyed = tokens.select("token", F.explode(stems(t)).alias("key")).join(term.select("term", F.explode(stems(F.col("term"))).alias("key")), "key").where(same_token(t, F.col("term")))
    places = F.sequence(F.lit(1), F.length("token"))
    begins = tokens.select("token", F.explode(F.transform(places, lambda k: F.substring(t, F.lit(1), k))).alias("term")).join(lists.where(~one).select(F.element_at("terms", -1).alias("term")).distinct(), "term")
    ends = tokens.select("token", F.explode(F.transform(places, lambda k: F.substring(t, k, F.length(t)))).alias("term")).join(lists.where(~one).select(F.get("terms", F.lit(0)).alias("term")).distinct(), "term")
    holds = _holders(tokens, lists.where(one).select(F.get("terms", F.lit(0)).alias("term")).distinct())
    says = lambda df, how: df.select("token", how.alias("how"), "term")
    return says(keyed, F.when(t == F.col("term"), "=").otherwise("~")).unionByName(says(begins, F.lit("<"))).unionByName(says(ends, F.lit(">"))).unionByName(says(holds, F.lit("c"))).distinct()


def _holders(tokens: DataFrame, term: DataFrame) -> DataFrame:
    """(token, term): tokens and the terms inside them; a term's first run of characters is a run of any token that contains it."""
    runs = tokens.select("token", F.explode(_runs(F.col("token"))).alias("run"))
    return runs.join(term.select("term", F.substring("term", 1, 3).alias("run")), "run").where(F.contains("token", F.col("term"))).select("token", "term")


def ranked(entries: DataFrame, queries: DataFrame, most: int = MOST) -> DataFrame:
    """(query, rank, name) and the features of the best ``most`` entries of each query; a query without tokens is left out.

    Tokens that meet all terms alike stand for each other, so entries fall into shapes: a name's tokens, its steps, and the terms that its
    description holds. Queries of equal terms are ranked once, over shapes; only shapes that may reach the best ``most`` are joined to
    their entries, of which each shape gives its ``most`` least names.
    """
    if not 1 <= most <= MOST:
        raise ValueError(f"at most 1 to {MOST} results are given")
    own = entries.where("name is not null").select("name", search_tokens(F.col("name")).alias("tokens"), search_tokens(F.col("description")).alias("words"))
    asked = queries.select("query", search_tokens(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    lists = checkpointed(asked.select("terms").distinct())
    term = lists.select("terms", F.explode(F.array_distinct("terms")).alias("term"))
    # tokens of names: the least of those with the same facts stands for them, a blank for those without any
    vocabulary = own.select(F.explode("tokens").alias("token")).distinct()
    facts = checkpointed(_token_facts(vocabulary, lists).groupBy("token").agg(F.sort_array(F.collect_set(F.struct("how", "term"))).alias("facts")))
    stands = facts.groupBy("facts").agg(F.min("token").alias("stand"))
    spread = own.select("name", F.posexplode("tokens").alias("at", "token")).distinct().join(facts.join(stands, "facts").select("token", "stand"), "token", "left")
    shapes = spread.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("stand", F.lit(" ")).alias("stand")))).alias("shape")).select("name", F.col("shape.stand").alias("shape"))
    # descriptions: the terms that they hold
    words = own.select(F.explode("words").alias("token")).distinct()
    said = own.select("words", F.explode("words").alias("token")).distinct().join(_holders(words, term.select("term").distinct()), "token").groupBy("words").agg(F.sort_array(F.collect_set("term")).alias("said"))
    none = F.array().cast("array<string>")
    rows = workflow(own).join(shapes, "name", "left").join(said, "words", "left").select("name", F.coalesce("shape", none).alias("tokens"), "plans", "applies", F.coalesce("said", none).alias("said"))
    shape = ["tokens", "plans", "applies"]
    alike = W.partitionBy(*shape, "said")
    rows = checkpointed(rows.withColumns({"n": F.count("*").over(alike), "k": F.row_number().over(alike.orderBy("name"))}).where(F.col("k") <= most))
    sizes = rows.where("k = 1").groupBy(*shape).agg(F.sum("n").alias("n"))
    met = sizes.select(*shape, "n", F.explode("tokens").alias("stand")).distinct().join(stands.select("stand", F.explode("facts.term").alias("term")).distinct(), "stand").join(term, "term").select(*shape, "n", "terms").distinct()
    rated = checkpointed(_features(met).where("exact + phrase + name_hits > 0"))
    order = [F.desc("exact"), F.desc("explicit"), F.desc("phrase"), F.desc("name_hits"), F.desc("safety"), F.asc("distance")]
    better = F.sum("n").over(W.partitionBy("terms").orderBy(*order).rangeBetween(W.unboundedPreceding, 0)) - F.sum("n").over(W.partitionBy("terms", *FEATURES))
    best = rated.withColumn("better", better).where(F.col("better") < most).drop("better", "n").join(rows.drop("n", "k"), shape)
    # where names give fewer, descriptions alone
    enough = rated.groupBy("terms").agg(F.sum("n").alias("n")).where(F.col("n") >= most)
    short = term.join(enough, "terms", "left_anti")
    told = rows.drop("n", "k").withColumn("term", F.explode("said")).join(short, "term").drop("term").distinct().join(rated.select("terms", *shape), ["terms", *shape], "left_anti")
    found = best.unionByName(_features(told)).withColumn("description_hits", F.size(F.filter("terms", lambda t: F.array_contains("said", t))))
    place = F.row_number().over(W.partitionBy("terms").orderBy(*order, F.desc("description_hits"), "name"))
    found = found.withColumn("rank", place).where(F.col("rank") <= most).drop(*shape, "said")
    return asked.join(found, "terms").select("query", "name", *FEATURES, "description_hits", "rank")


def _features(pairs: DataFrame) -> DataFrame:
    """Pairs of a list of terms and a name's tokens with the features that the name decides."""
    terms, tokens = F.col("terms"), F.col("tokens")
    whole, phrase = F.array_join(tokens, " "), F.array_join(terms, " ")
    explicit = F.array_contains(terms, "apply") & ~F.array_contains(terms, "plan")
    flag = lambda c: c.cast("int")
    hits = F.size(F.filter(terms, lambda t: F.exists(tokens, lambda x: same_token(x, t))))
    return pairs.withColumns({
        "exact": flag(whole == phrase), "explicit": flag(explicit & F.col("applies")), "phrase": flag(F.contains(whole, phrase)),
        "name_hits": hits, "safety": flag(~explicit & F.col("plans")), "distance": distance(tokens, terms),
    })
