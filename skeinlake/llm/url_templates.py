"""URL filters by a path-template tree: variable segments become wildcards, similar branches merge, impure templates are rejected.

The tree is grown level by level for all hosts at once. A child of a node stays literal if enough of the node's pages go
through it; the rest share a wildcard, apart by file extension. Then, from the leaves up, branches that differ in one
segment alone are ordered by labelled purity, and each joins the branch before it unless it differs significantly from the
branch as a whole or from any member of it. What is left are templates, and a template's purity, smoothed towards that of the corpus, decides over all its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Segments from this one on count together as one.
DEPTH = 8
#: A literal child needs so many pages, and this share of its node's.
LEAST_PAGES, LEAST_SHARE = 5, 0.02
#: Standard errors by which the smoothed purities of two branches may differ that still merge.
Z = 2.0
#: Weight of the corpus's purity, in labelled pages, and the purity below which a template is rejected.
PRIOR_WEIGHT, LEAST_PURITY = 5.0, 0.5

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
KEY = "([0-9]+)[^0-9/]*/?$"
EXTENSION = "[.][A-Za-z]{1,5}$"


def _parsed(pages: DataFrame, depth: int) -> DataFrame:
    url = F.trim(F.col("url").cast("string"))
    path = F.regexp_extract(url, PATH, 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(F.slice(parts, depth, F.size(parts)), "/")))).otherwise(parts)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("")).alias("host"),
        parts.alias("parts"),
        F.regexp_extract(path, KEY, 1).try_cast("bigint").alias("key"),
    )


def _branches(rows: Column, z: float, weight: float, prior: Column) -> Column:
    """The branch of each of some rows (rate, current, n, g, ...) sorted by their rate; those of one current are one sibling.

    A branch's counts are those of its siblings, with the prior's weight once.
    """

    def apart(n, g, m) -> Column:
        p = (g + m["g"]) / (n + m["n"])
        return F.abs(g / n - m["g"] / m["n"]) > z * F.sqrt(p * (1 - p) * (1 / n + 1 / m["n"]))

    def step(acc: Column, x: Column) -> Column:
        done, last = F.size(acc["of"]), F.element_at(acc["of"], -1)
        same = F.element_at(rows, done)["current"] == x["current"]
        members = F.slice(rows, acc["since"], done + 1 - acc["since"])
        new = ~same & (apart(acc["n"], acc["g"], x) | F.exists(members, lambda m: apart(m["n"], m["g"], x)))
        add = lambda name, less: F.when(same, acc[name]).otherwise(acc[name] + x[name] - less)
        # As a lambda's variable the answer is worked out once.
        return F.transform(
            F.array(new),
            lambda n: F.struct(
                F.concat(acc["of"], F.array(last + n.cast("int"))).alias("of"),
                F.when(n, x["n"]).otherwise(add("n", F.lit(weight))).alias("n"),
                F.when(n, x["g"]).otherwise(add("g", weight * prior)).alias("g"),
                F.when(n, done + 1).otherwise(acc["since"]).alias("since"),
            ),
        )[0]

    first = F.struct(F.array(F.lit(1)).alias("of"), rows[0]["n"].alias("n"), rows[0]["g"].alias("g"), F.lit(1).alias("since"))
    return F.aggregate(F.slice(rows, 2, F.size(rows)), first, step, lambda acc: acc["of"])


def url_templates(pages: DataFrame, labels: DataFrame, depth: int = DEPTH, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, z: float = Z, prior_weight: float = PRIOR_WEIGHT, least_purity: float = LEAST_PURITY) -> DataFrame:
    """(page_id, host, template, n_pages, n_labelled, purity, keep) for each row of pages.

    A page's label is that of the document whose id ends its path: good if quality is 1 and toxic isn't. A document with
    several labels is good if all are; null labels aren't counted. Rows with a null url, or one without scheme and host,
    have no template: null in the columns between, kept. An empty path is the template "/"; merged segments read (a|b). Ids may be null or repeat: each
    row is a page. Without labels every purity is null and every page is kept.
    """
    state = _parsed(pages, depth).withColumn("tokens", F.array().cast("array<string>"))
    state = stored(state, "url-0")
    deepest = state.agg(F.max(F.size("parts"))).first()[0] or 0
    for k in range(deepest):
        part = F.get("parts", F.lit(k))
        node = state.where(F.col("host").isNotNull() & part.isNotNull()).select("host", F.array_join("tokens", "/").alias("node"), part.alias("part"))
        children = node.groupBy("host", "node", "part").agg(F.count("*").alias("n"))
        # The totals are of nodes, the candidates few: both are far smaller than the pages, however hot a host is.
        totals = node.groupBy("host", "node").agg(F.count("*").alias("total"))
        literal = children.where(F.col("n") >= least_pages).join(totals, ["host", "node"]).where(F.col("n") >= F.col("total") * least_share).select(F.col("host").alias("_host"), F.col("node").alias("_node"), F.col("part").alias("_part"))
        wild = F.concat(F.lit("*"), F.regexp_extract(part, EXTENSION, 0))
        token = F.when(part.isNull(), None).when(F.col("_part").isNotNull(), part).otherwise(wild)
        state = state.join(literal, (F.col("host") == F.col("_host")) & (F.array_join("tokens", "/") == F.col("_node")) & (part == F.col("_part")), "left")
        state = stored(state.select("page_id", "host", "parts", "key", F.when(token.isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array(token))).alias("tokens")), f"url-{k + 1}")

    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.min(good).alias("good"))
    labelled = state.where("host is not null").join(known, F.col("key") == F.col("_doc"), "left")
    templates = labelled.groupBy("host", "tokens").agg(F.count("*").alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    overall = templates.agg((F.sum("good") / F.nullif(F.sum("labelled"), F.lit(0))).alias("prior"))
    # One row, joined to all: the corpus's purity.
    templates = templates.crossJoin(F.broadcast(overall)).withColumn("current", F.col("tokens"))
    for k in reversed(range(deepest)):
        # Templates that differ in segment k alone, in the order of their smoothed purity; a significant difference begins a new branch.
        general = F.transform("current", lambda t, i: F.when(i == k, F.lit("*")).otherwise(t))
        own = Window.partitionBy("host", "current")
        known_prior = F.coalesce(F.col("prior"), F.lit(0.5))
        templates = templates.withColumn("general", general).withColumns({"n": F.sum("labelled").over(own) + prior_weight, "g": F.sum("good").over(own) + prior_weight * known_prior})
        row = F.struct((F.col("g") / F.col("n")).alias("rate"), "current", "tokens", "pages", "labelled", "good", "n", "g")
        siblings = templates.groupBy("host", "general", "prior").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("branch", _branches(F.col("rows"), z, prior_weight, known_prior))
        templates = siblings.select("host", "general", "prior", F.explode(F.arrays_zip("rows", "branch")).alias("x")).select("host", "general", "prior", "x.rows.*", "x.branch")
        members = F.array_sort(F.collect_set(F.get("current", F.lit(k))).over(Window.partitionBy("host", "general", "branch")))
        templates = templates.withColumn("members", members)
        merged = F.transform("current", lambda t, i: F.when(i == k, F.concat(F.lit("("), F.array_join("members", "|"), F.lit(")"))).otherwise(t))
        templates = templates.withColumn("current", F.when(F.size("members") > 1, merged).otherwise(F.col("current"))).select("host", "tokens", "pages", "labelled", "good", "current", "prior")
    own = Window.partitionBy("host", "current")
    templates = templates.withColumns({"n_pages": F.sum("pages").over(own), "n_labelled": F.sum("labelled").over(own), "n_good": F.sum("good").over(own)})
    purity = (F.col("n_good") + prior_weight * F.col("prior")) / (F.col("n_labelled") + prior_weight)
    judged = templates.select(F.col("host").alias("_host"), F.col("tokens").alias("_tokens"), F.concat(F.lit("/"), F.array_join("current", "/")).alias("template"), "n_pages", "n_labelled", purity.alias("purity"))
    return state.join(judged, (F.col("host") == F.col("_host")) & (F.col("tokens") == F.col("_tokens")), "left").select("page_id", "host", "template", "n_pages", "n_labelled", F.round("purity", 9).alias("purity"), F.coalesce(F.col("purity") >= least_purity, F.lit(True)).alias("keep"))


def _oracle(depth: int = DEPTH) -> str:
    q = lambda s: s.replace("'", "''")
    steps = [
        f"""s0 AS MATERIALIZED (SELECT page_id, nullif(lower(regexp_extract(trim(url), '{q(HOST)}', 1)), '') AS host, path,
  CASE WHEN len(p) > {depth} THEN list_concat(p[1:{depth - 1}], [array_to_string(p[{depth}:], '/')]) ELSE p END AS parts,
  try_cast(regexp_extract(path, '{q(KEY)}', 1) AS BIGINT) AS key, CAST([] AS VARCHAR[]) AS tokens, row_number() OVER () AS rid
  FROM (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS p FROM (SELECT page_id, url, regexp_extract(trim(url), '{q(PATH)}', 1) AS path FROM pages)))"""
    ]
    for k in range(depth):
        steps.append(
            f"""c{k} AS MATERIALIZED (SELECT host, array_to_string(tokens, '/') AS node, parts[{k + 1}] AS part, count(*) AS n FROM s{k} WHERE host IS NOT NULL AND parts[{k + 1}] IS NOT NULL GROUP BY ALL),
l{k} AS MATERIALIZED (SELECT host, node, part FROM (SELECT *, sum(n) OVER (PARTITION BY host, node) AS total FROM c{k}) WHERE n >= {LEAST_PAGES} AND n >= total * {LEAST_SHARE!r}::DOUBLE),
s{k + 1} AS MATERIALIZED (SELECT s.* EXCLUDE (tokens), CASE WHEN parts[{k + 1}] IS NULL THEN tokens WHEN l.part IS NOT NULL THEN list_append(tokens, parts[{k + 1}]) ELSE list_append(tokens, '*' || regexp_extract(parts[{k + 1}], '{EXTENSION}', 0)) END AS tokens
  FROM s{k} s LEFT JOIN l{k} l ON s.host = l.host AND array_to_string(s.tokens, '/') = l.node AND s.parts[{k + 1}] = l.part)"""
        )
    steps.append(
        f"""known AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
m{depth} AS MATERIALIZED (SELECT host, tokens, count(*) AS pages, count(good) AS labelled, coalesce(sum(good), 0) AS good, tokens AS current FROM s{depth} LEFT JOIN known ON key = doc_id WHERE host IS NOT NULL GROUP BY host, tokens)"""
    )
    w = f"{PRIOR_WEIGHT!r}::DOUBLE"
    steps.append(f"prior AS MATERIALIZED (SELECT sum(good) / nullif(sum(labelled), 0) AS prior FROM m{depth})")
    for k in reversed(range(depth)):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT *, CASE WHEN len(current) > {k} THEN list_concat(list_append(current[1:{k}], '*'), current[{k + 2}:]) ELSE current END AS general FROM m{k + 1}),
b{k} AS MATERIALIZED (SELECT *, sum(labelled) OVER (PARTITION BY host, current) + {w} AS n, sum(good) OVER (PARTITION BY host, current) + {w} * coalesce((SELECT prior FROM prior), 0.5::DOUBLE) AS g FROM a{k}),
c_{k} AS MATERIALIZED (SELECT *, lag(n) OVER v AS n0, lag(g) OVER v AS g0 FROM b{k} WINDOW v AS (PARTITION BY host, general ORDER BY g / n, current, tokens)),
d{k} AS MATERIALIZED (SELECT *, sum(CASE WHEN coalesce(abs(g / n - g0 / n0) > {Z!r}::DOUBLE * sqrt((g + g0) / (n + n0) * (1 - (g + g0) / (n + n0)) * (1 / n + 1 / n0)), true) THEN 1 ELSE 0 END) OVER (PARTITION BY host, general ORDER BY g / n, current, tokens ROWS UNBOUNDED PRECEDING) AS branch FROM c_{k}),
e{k} AS MATERIALIZED (SELECT *, list_sort(list_distinct(list(current[{k + 1}]) OVER (PARTITION BY host, general, branch))) AS members FROM d{k}),
m{k} AS MATERIALIZED (SELECT host, tokens, pages, labelled, good, CASE WHEN len(members) > 1 THEN list_concat(list_append(current[1:{k}], '(' || array_to_string(members, '|') || ')'), current[{k + 2}:]) ELSE current END AS current FROM e{k})"""
        )
    return f"""WITH {', '.join(steps)},
judged AS (SELECT host, tokens, '/' || array_to_string(current, '/') AS template, CAST(sum(pages) OVER w AS BIGINT) AS n_pages, CAST(sum(labelled) OVER w AS BIGINT) AS n_labelled,
  (sum(good) OVER w + {PRIOR_WEIGHT!r}::DOUBLE * (SELECT prior FROM prior)) / (sum(labelled) OVER w + {PRIOR_WEIGHT!r}::DOUBLE) AS purity FROM m0 WINDOW w AS (PARTITION BY host, current))
SELECT page_id, s.host, template, n_pages, n_labelled, round(purity, 9) AS purity, coalesce(purity >= {LEAST_PURITY!r}, true) AS keep
FROM s{depth} s LEFT JOIN judged j ON s.host = j.host AND s.tokens = j.tokens"""


ORACLE = _oracle()
