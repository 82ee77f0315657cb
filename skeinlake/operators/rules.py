"""Rules, scores and risk over tables of changes, functions, classes, findings and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lookups import CHANGE_IMPACT, CHANGE_RISK, RISK_RANK, RISK_SCORE, SCANNER_TO_REVIEW, case

ADVICE = ((70, "review by the architecture owners before release"), (40, "run the full regression suite"), (15, "run the tests of the changed modules"))
SUGGESTIONS = {"FunctionRemoved": "keep a deprecated alias", "FunctionSignatureChanged": "add an overload", "ParameterCountChanged": "give new parameters defaults", "ReturnTypeChanged": "offer a conversion", "VisibilityChanged": "check outside callers", "InterfaceChanged": "version the interface", "StructureChanged": "migrate stored data", "ModuleStructureChanged": "re-export moved names", "FunctionAdded": "document the function"}
PATTERNS = (("javascript", "eval("), ("javascript", "innerHTML"), ("python", "exec("), ("rust", "unsafe "), ("java", "Runtime.getRuntime"))
CATEGORY_ADVICE = {"architecture": "revisit module boundaries", "security": "schedule a security review", "performance": "profile the hot paths", "quality": "refactor long functions"}


def change_risk(changes: DataFrame) -> DataFrame:
    """Each change with its risk and impact level."""
    return changes.withColumns({"risk": case(F.col("change_type"), CHANGE_RISK), "impact": case(F.col("change_type"), CHANGE_IMPACT)})


def overall_risk(changes: DataFrame, by: str) -> DataFrame:
    """The worst risk of each group of changes."""
    rank = F.max(case(case(F.col("change_type"), CHANGE_RISK), RISK_RANK, 0))
    return changes.groupBy(by).agg(rank.alias("rank")).select(by, case(F.col("rank"), {v: k for k, v in RISK_RANK.items()}).alias("overall_risk"))


def risk_score(changes: DataFrame, by: str) -> DataFrame:
    """Weighted average of the risks' scores, by integer division and at most 100."""
    risk = case(F.col("change_type"), CHANGE_RISK)
    score, weight = (case(risk, {k: v[i] for k, v in RISK_SCORE.items()}, 0) for i in (0, 1))
    return changes.groupBy(by).agg(F.sum(score * weight).alias("s"), F.sum(weight).alias("w")).select(by, F.coalesce(F.least(F.floor(F.try_divide("s", "w")), F.lit(100)), F.lit(0)).cast("long").alias("risk_score"))


def mitigations(changes: DataFrame, by: str) -> DataFrame:
    """(by, place, advice): the tier of the risk score first, then the suggestions of the change types in the order they first occur."""
    score = risk_score(changes, by)
    tier = None
    for least, advice in ADVICE:
        tier = F.when(F.col("risk_score") >= least, advice) if tier is None else tier.when(F.col("risk_score") >= least, advice)
    first = score.select(by, F.lit(-1).cast("long").alias("at"), tier.alias("advice")).where("advice is not null")
    rest = changes.withColumn("advice", case(F.col("change_type"), SUGGESTIONS)).where("advice is not null").groupBy(by, "advice").agg(F.min("change_id").alias("at"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("at", "advice"))
    return first.unionByName(rest.select(by, "at", "advice")).select(by, place.alias("place"), "advice")


def of_kind(changes: DataFrame, change_type: str | None = None, risk: str | None = None) -> DataFrame:
    """Changes of one type, or of one risk."""
    out = changes
    if change_type is not None:
        out = out.where(F.col("change_type") == change_type)
    if risk is not None:
        out = out.where(case(F.col("change_type"), CHANGE_RISK) == risk)
    return out


def pattern_violations(functions: DataFrame, classes: DataFrame, methods: int = 20, lines: int = 50) -> DataFrame:
    """Classes with too many methods and functions with too many lines."""
    length = F.col("line_end") - F.col("line_start")
    big = classes.where(F.col("n_methods") > methods).select("file_path", "name", F.lit("large class").alias("violation"), F.lit("Medium").alias("severity"))
    long = functions.where(length > lines).select("file_path", "name", F.lit("long function").alias("violation"), F.when(length > 2 * lines, "High").otherwise("Medium").alias("severity"))
    return big.unionByName(long)


def hotspots(functions: DataFrame, params: int = 5, lines: int = 50) -> DataFrame:
    """Functions with many parameters or lines, a score of lines + 5 * parameters, and the reasons."""
    length = F.col("line_end") - F.col("line_start")
    many, long = F.col("n_params") > params, length > lines
    reasons = F.array_compact(F.array(F.when(many, "too many parameters"), F.when(long, "too long")))
    return functions.where(many | long).select("file_path", "name", "ord", (length + 5 * F.col("n_params")).cast("double").alias("score"), reasons.alias("reasons"))


def debt(spots: DataFrame, by: str) -> DataFrame:
    """Debt and remediation hours by the number of hotspots."""
    return spots.groupBy(by).agg((F.count("*") * 10.0).alias("debt"), (F.count("*") * 2.5).alias("hours"))


def insight_impact(changes: DataFrame, by: str) -> DataFrame:
    """10 for each breaking change and 5 for each distinct component, banded."""
    breaking = F.count_if(case(F.col("change_type"), CHANGE_RISK).isin("Critical", "High"))
    score = (10 * breaking + 5 * F.countDistinct("component")).cast("long")
    band = F.when(F.col("score") > 50, "Critical").when(F.col("score") > 30, "High").when(F.col("score") > 10, "Medium").otherwise("Low")
    return changes.groupBy(by).agg(score.alias("score")).withColumn("band", band)


def public_api(functions: DataFrame) -> DataFrame:
    """Public functions and their stability."""
    return functions.where("visibility = 'public'").select("file_path", "name", "n_params", F.lit("function").alias("kind"))


def repeated_lines(lines: DataFrame, key: str, least: int = 4) -> DataFrame:
    """(key, line, pos, run): the first run of at least so many equal non-blank lines of each text; blank lines neither count nor break a run."""
    solid = lines.where(F.trim("line") != "")
    w = Window.partitionBy(key).orderBy("pos")
    marked = solid.withColumn("start", F.when(F.col("line").eqNullSafe(F.lag("line").over(w)), 0).otherwise(1)).withColumn("island", F.sum("start").over(w))
    runs = marked.groupBy(key, "island").agg(F.min("line").alias("line"), F.min("pos").alias("pos"), F.count("*").alias("run")).where(F.col("run") >= least)
    return runs.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("k = 1").select(key, "line", "pos", "run")


def long_texts(lines: DataFrame, key: str, most: int = 100) -> DataFrame:
    """Texts of more than so many lines."""
    return lines.groupBy(key).agg(F.count("*").alias("n_lines")).where(F.col("n_lines") > most)


def marker_lines(lines: DataFrame, key: str, markers: tuple[str, ...] = ("todo", "fixme", "hack")) -> DataFrame:
    """Lines with one of the markers, whatever their case."""
    return lines.where(F.lower("line").rlike("|".join(markers))).select(key, "pos", F.trim("line").alias("line"))


def risky_patterns(lines: DataFrame, key: str, patterns: DataFrame) -> DataFrame:
    """One row for each pattern (lang, pattern) and line of that language that contains it. The pattern table is a constant of the rules, a few rows."""
    p = patterns.select(F.col("lang").alias("_lang"), "pattern")
    return lines.join(p, (F.col("lang") == F.col("_lang")) & F.col("line").contains(F.col("pattern"))).select(key, "lang", "pos", "pattern")


def structure_rules(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Files with over 20 functions or over 5 classes, functions of over 50 lines or 5 parameters."""
    f = functions.groupBy("file_path").agg(F.count("*").alias("n")).where("n > 20").select("file_path", F.lit(None).cast("string").alias("name"), F.lit("too many functions").alias("rule"), "n")
    c = classes.groupBy("file_path").agg(F.count("*").alias("n")).where("n > 5").select("file_path", F.lit(None).cast("string").alias("name"), F.lit("too many classes").alias("rule"), "n")
    size = (F.col("line_end") - F.col("line_start")).cast("long")
    long = functions.where(size > 50).select("file_path", "name", F.lit("function too long").alias("rule"), size.alias("n"))
    wide = functions.where("n_params > 5").select("file_path", "name", F.lit("too many parameters").alias("rule"), F.col("n_params").cast("long").alias("n"))
    return f.unionByName(c).unionByName(long).unionByName(wide)


def insight_summary(findings: DataFrame, by: str) -> DataFrame:
    """Findings by severity, an architecture score (100 less 20, 10, 5 and 2 by severity, 0 at least) and the worst-first verdict."""
    n = {s: F.count_if(F.col("severity") == s) for s in ("Critical", "High", "Medium", "Low")}
    out = findings.groupBy(by).agg(*[v.alias(k.lower()) for k, v in n.items()], F.count("*").alias("total"))
    score = F.greatest(F.lit(0), 100 - 20 * F.col("critical") - 10 * F.col("high") - 5 * F.col("medium") - 2 * F.col("low")).cast("long")
    verdict = F.when(F.col("critical") > 0, "critical issues").when(F.col("high") > 0, "high risk").when(F.col("medium") > 0, "needs work").otherwise("good")
    return out.withColumns({"architecture_score": score, "verdict": verdict})


def category_advice(findings: DataFrame, by: str) -> DataFrame:
    """The recommendation of each category present."""
    return findings.select(by, "category").distinct().select(by, case(F.col("category"), CATEGORY_ADVICE).alias("advice")).where("advice is not null")


def model_insights(answers: DataFrame) -> DataFrame:
    """(id, kind, message, severity) of JSON answers: issues, coverage below 0.8, deviations. Malformed answers give nothing."""
    schema = "issues array<struct<severity:string,message:string>>, coverage double, deviations array<struct<message:string,severity:string>>"
    a = answers.select("id", F.from_json("body", schema).alias("a"))
    issues = a.select("id", F.explode("a.issues").alias("i")).select("id", F.lit("issue").alias("kind"), F.col("i.message").alias("message"), F.coalesce("i.severity", F.lit("Medium")).alias("severity"))
    cover = a.where("a.coverage < 0.8").select("id", F.lit("coverage").alias("kind"), F.concat(F.lit("coverage "), F.round(F.col("a.coverage") * 100).cast("int").cast("string"), F.lit("%")).alias("message"), F.lit("Medium").alias("severity"))
    away = a.select("id", F.explode("a.deviations").alias("i")).select("id", F.lit("deviation").alias("kind"), F.col("i.message").alias("message"), F.coalesce("i.severity", F.lit("Medium")).alias("severity"))
    return issues.unionByName(cover).unionByName(away)


def review_score(lines: DataFrame, key: str, findings: DataFrame, default: int = 85) -> DataFrame:
    """(key, score): the first number of 0 to 100 on a line that speaks of a score, or the default, less 10 for each Critical or High finding, 0 at least."""
    said = F.regexp_extract("line", r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    hits = lines.where(F.lower("line").rlike("score|rating")).withColumn("said", said).where("said between 0 and 100").groupBy(key).agg(F.min_by("said", "pos").alias("said"))
    bad = findings.where("severity in ('Critical', 'High')").groupBy(key).agg(F.count("*").alias("bad"))
    ids = lines.select(key).distinct()
    return ids.join(hits, key, "left").join(bad, key, "left").select(key, F.greatest(F.lit(0.0), F.coalesce("said", F.lit(float(default))) - 10 * F.coalesce("bad", F.lit(0))).alias("score"))


def key_value(text: Column, key: str) -> Column:
    """The number after `key:` in a text, null without one."""
    return F.regexp_extract(text, rf"{key}\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def severity_levels(findings: DataFrame) -> DataFrame:
    """Counts of scanner findings by the review level they map to."""
    level = case(F.upper("scanner_severity"), SCANNER_TO_REVIEW, "Info")
    return findings.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def complexity_band(value: Column) -> Column:
    """Bands of a complexity at 5, 10, 20 and 50."""
    return F.when(value <= 5, "simple").when(value <= 10, "moderate").when(value <= 20, "complex").when(value <= 50, "very complex").otherwise("unmaintainable")


def quality_score(complexity: Column, duplication: Column, coverage: Column, debt_ratio: Column, smells: Column, vulnerabilities: Column) -> Column:
    """100 less penalties; a null input costs nothing; between 0 and 100."""
    zero = F.lit(0.0)
    parts = [2.0 * F.greatest(complexity - 10, zero), 0.5 * duplication, 0.5 * F.greatest(80 - coverage, zero), 10.0 * debt_ratio, 2.0 * smells, 10.0 * vulnerabilities]
    nulls = (complexity, duplication, coverage, debt_ratio, smells, vulnerabilities)
    score = F.lit(100.0)
    for source, part in zip(nulls, parts):
        score = score - F.when(source.isNull(), zero).otherwise(part.cast("double"))
    return F.least(F.greatest(score, zero), F.lit(100.0))


def undetected(spark: SparkSession) -> DataFrame:
    """(name, problem) of detectors without a rule: no rows."""
    return spark.createDataFrame([], "name string, problem string")


def layers(spark: SparkSession) -> DataFrame:
    """The one layer that is assumed, what it may depend on, and the coupling that is assumed; both are constants in the original as well."""
    return spark.createDataFrame([("Domain", "Infrastructure", 0.3)], "layer string, allowed string, average_coupling double")


def deviation(findings: DataFrame, by: str, connected: bool = False) -> DataFrame:
    """(by, matched, match_score, needs_attention): the fixed score of an analysis, 85 with a connected tracker and 50 without; all findings count as matched."""
    return findings.groupBy(by).agg(F.count("*").alias("matched")).select(by, "matched", F.lit(85 if connected else 50).alias("match_score"), F.lit(False).alias("needs_attention"))
