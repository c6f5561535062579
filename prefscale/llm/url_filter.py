"""URL filters: rules first, then path templates judged by labelled purity.

Per host, paths form a tree of segments. Segments that look variable (numbers, hashes, codes) become wildcards at once,
so that a host's pages collapse to few rows by a map-side aggregate. Then the tree is walked level by level: among the
children of a node, a branch whose labels and depth are statistically like those of its siblings is merged into a
wildcard; one that differs, or that alone has labels, stays. For this test only, a page without a label is taken to be
what most labelled pages of its raw template are, on whatever host.

A template's purity is the smoothed share of bad pages among its labelled ones. It is shrunk towards the mean of two
others: its host's, which is shrunk towards its domain's (the last two names of the host) and that towards all pages',
and the purity of the same raw templates over all hosts, shrunk towards all pages' too. So labels reach pages without
any, by the place where they lie and by their form elsewhere. Templates above the threshold are rejected. Labels are the
rules' verdicts and those of a given table; pages without either are unlabelled.

Counts are summed as whole numbers, so results don't depend on the order of rows. A host or template with very many
pages is one row after the first, map-side, sum; pages meet their template's purity in a join on (host, raw) that Spark
splits where it is skewed, as the other side has one row a key.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed unless a rule or the
purity of such pages says otherwise; every page gives one row; rows that repeat a page are judged alike. Below the eighth segment
(``max_depth``) all paths are one branch ``**``; a segment of more than 32 characters (``LONG_SEGMENT``) counts as
variable. A label without a page, or null, is none; of several of one page the worst counts.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscale.llm.text import packed
from prefscale.session import cut, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that, as parts of a host name or path, label pages as junk in ``judge_urls_by_tree``.
JUNK_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx")
MAX_DEPTH = 8
#: The share of bad pages that an unlabelled template is taken to have, and how many labelled pages that is worth.
PRIOR, PRIOR_WEIGHT = 0.2, 4.0
REJECT = 0.5
SIMILAR_Z = 1.96
SIMILAR_DEPTH = 0.5
#: The purity from which ``judge_urls`` rejects: above what one of the two means alone can give.
REJECT_PURITY = 0.6
#: Longer segments are taken for variable.
LONG_SEGMENT = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. The rules are a short list, tried in each row."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        of, _, below = rule.partition("/")
        there = (host == of) | host.endswith(f".{of}")
        fits.append(F.when(there & path.startswith(f"/{below}"), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def shape(segment: Column) -> Column:
    """A segment, or the wildcard for what it looks like."""
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), "{n}")
        .when(segment.rlike(r"^[0-9a-fA-F-]{8,}$"), "{h}")
        .when(segment.rlike(r"[0-9]") | (F.length(segment) > LONG_SEGMENT), "{v}")
        .otherwise(segment)
    )


def raw_template(path: Column, max_depth: int | None = MAX_DEPTH) -> Column:
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)
    if max_depth is None:
        return parts
    tail = F.array(F.lit("**"))
    return F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), tail)).otherwise(parts)


def domain(host: Column) -> Column:
    """The last two names of a host."""
    return F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), F.lit(2)), ".")


def shrunk(bad: Column, lab: Column, towards: Column) -> Column:
    return (bad + PRIOR_WEIGHT * towards) / (lab + PRIOR_WEIGHT)


def templates(labelled: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """labelled (host, raw, bad: 1, 0 or null) -> (host, raw, template, purity): merged branches and smoothed purity."""
    own = cut(labelled.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    counts = [F.sum(c).alias(c) for c in ("lab", "bad")]
    form = own.groupBy("raw").agg(*[F.sum(c).alias(f"form_{c}") for c in ("lab", "bad")])
    hint = F.when(F.col("form_lab") > 0, (2 * F.col("form_bad") >= F.col("form_lab")).cast("long"))
    rows = own.join(form, "raw").withColumn("segs", F.col("raw")).withColumns({"own_lab": F.col("lab"), "own_bad": F.col("bad")})
    blank = F.col("n") - F.col("own_lab")
    rows = rows.withColumns({"lab": F.col("own_lab") + F.when(hint.isNotNull(), blank).otherwise(0), "bad": F.col("own_bad") + F.coalesce(blank * hint, F.lit(0))})
    rows = cut(rows)
    depth = rows.agg(F.max(F.size("raw"))).first()[0] or 0
    for level in range(depth if max_depth is None else min(depth, max_depth)):
        rows = merge_level(rows, level)
    every = own.agg(F.coalesce(F.sum("lab"), F.lit(0)).alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    p_all = F.lit((every["bad"] + PRIOR_WEIGHT * PRIOR) / (every["lab"] + PRIOR_WEIGHT))
    hosts = own.groupBy("host").agg(*counts).withColumn("domain", domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(*counts).select("domain", shrunk(F.col("bad"), F.col("lab"), p_all).alias("p_domain"))
    hosts = hosts.join(domains, "domain").select("host", shrunk(F.col("bad"), F.col("lab"), F.col("p_domain")).alias("p_host"))
    total = rows.groupBy("host", "segs").agg(*[F.sum(c).alias(c) for c in ("own_lab", "own_bad", "form_lab", "form_bad")]).join(hosts, "host")
    p_form = shrunk(F.col("form_bad"), F.col("form_lab"), p_all)
    total = total.select("host", "segs", shrunk(F.col("own_bad"), F.col("own_lab"), (F.col("p_host") + p_form) / 2).alias("purity"))
    return rows.select("host", "raw", "segs").join(total, ["host", "segs"]).select("host", "raw", F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"), "purity")


def merge_level(rows: DataFrame, level: int) -> DataFrame:
    """Segment ``level`` becomes ``*`` in the branches that are like their siblings below the same node."""
    rows = rows.withColumn("_up", F.slice("segs", 1, level)).withColumn("_seg", F.get("segs", F.lit(level)))
    sums = [F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum(F.col("n") * F.size("segs")).alias("deep")]
    child = rows.where("_seg is not null").groupBy("host", "_up", "_seg").agg(*sums)
    node = child.groupBy("host", "_up").agg(*[F.sum(c).alias(f"all_{c}") for c in ("lab", "bad", "n", "deep")], F.count("*").alias("branches"))
    both = child.join(node, ["host", "_up"])
    lab, rest = F.col("lab"), F.col("all_lab") - F.col("lab")
    p, q = (F.col("bad") + 0.5) / (lab + 1), (F.col("all_bad") - F.col("bad") + 0.5) / (rest + 1)
    pooled = (F.col("all_bad") + 1) / (F.col("all_lab") + 2)
    z = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / (lab + 1) + 1 / (rest + 1)))
    other_depth = (F.col("all_deep") - F.col("deep")) / (F.col("all_n") - F.col("n"))
    alike = (F.col("branches") > 1) & ((lab > 0) == (rest > 0)) & (z < SIMILAR_Z) & (F.abs(F.col("deep") / F.col("n") - other_depth) < SIMILAR_DEPTH)
    merged = both.where(alike & ~F.col("_seg").isin("{n}", "{h}", "{v}", "**")).select("host", "_up", "_seg", F.lit("*").alias("_new"))
    out = rows.join(merged, ["host", "_up", "_seg"], "left")
    segs = F.when(F.col("_new").isNull(), F.col("segs")).otherwise(F.concat("_up", F.array("_new"), F.slice("segs", level + 2, F.greatest(F.size("segs") - level - 1, F.lit(0)))))
    return cut(out.withColumn("segs", segs).select(*[c for c in rows.columns if c not in ("_up", "_seg")]))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, reject: float = REJECT_PURITY, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity; other columns stay, those of the same names are
    replaced. ``labels`` (page_id, bad: 1 or 0) tells of pages that no rule fits."""
    made = ("host", "path", "rule", "verdict", "template", "purity")
    columns = [c for c in pages.columns if c not in made]
    host, path = host_and_path(F.col("url"))
    rows = packed(pages.select(*[F.col(f"`{c}`") for c in columns]), "url", *(["page_id"] if labels is not None else []))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("judged", rule_for(F.col("host"), F.col("path"), rules)).withColumn("raw", raw_template(F.col("path"), max_depth))
    bad = (F.col("judged.verdict") == "block").cast("long")
    if labels is not None:
        known = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("told"))
        rows = rows.join(known, "page_id", "left")
        bad = F.coalesce(bad, F.col("told"))
    found = templates(rows.select("host", "raw", bad.alias("bad")), max_depth)
    rows = rows.join(found, ["host", "raw"], "left")
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    new = ["host", "path", F.col("judged.rule").alias("rule"), F.coalesce(F.col("judged.verdict"), own).alias("verdict"), "template", "purity"]
    return rows.select("_packed", *new).select("_packed.*", *made)


def tree_purity(labelled: DataFrame) -> DataFrame:
    """As ``templates``, to the whole depth and for each host alone, each node's purity shrunk towards its parent's and the host's towards PRIOR.

    A page without a label counts as PRIOR of a bad one, as labels by words are only ever bad: a few bad pages do not
    condemn a large host. A node without any label has its parent's purity.
    """
    rows = labelled.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = cut(rows.withColumn("segs", F.col("raw")))
    for level in range(rows.agg(F.max(F.size("raw"))).first()[0] or 0):
        rows = merge_level(rows, level)
    total = cut(rows.groupBy("host", "segs").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")]))
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size("segs")), lambda k: F.slice("segs", 1, k))).alias("_node")
    node = total.select("host", above, "n", "lab", "bad").groupBy("host", "_node").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")])
    way = total.select("host", "segs", above).join(node, ["host", "_node"])
    way = way.groupBy("host", "segs").agg(F.sort_array(F.collect_list(F.struct(F.size("_node").alias("k"), "n", "lab", "bad"))).alias("way"))
    share = lambda up, x: F.when(x["lab"] == 0, up).otherwise((x["bad"] + PRIOR * (x["n"] - x["lab"]) + PRIOR_WEIGHT * up) / (x["n"] + PRIOR_WEIGHT))
    total = way.select("host", "segs", F.aggregate("way", F.lit(PRIOR), share).alias("purity"))
    return rows.select("host", "raw", "segs").join(total, ["host", "segs"]).select("host", "raw", F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"), "purity")


def judge_urls_by_tree(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, junk_words: Sequence[str] = JUNK_WORDS, reject: float = REJECT) -> DataFrame:
    """As ``judge_urls``, with labels also from words in hosts and path segments and ``tree_purity``; a page's own label decides first."""
    made = ("host", "path", "rule", "verdict", "template", "purity", "raw")
    host, path = host_and_path(F.col("url"))
    rows = pages.drop(*made).withColumn("host", host).withColumn("path", path)
    parts = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), shape)
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("raw", parts)
    words = "|".join(junk_words)
    junk = F.col("host").rlike(rf"(^|[.-])({words})([.-]|$)") | F.lower("path").rlike(rf"[/._-]({words})([/._-]|$)")
    bad = F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "block").cast("int")).when(junk, 1)
    rows = rows.withColumn("_bad", bad)
    found = tree_purity(rows.select("host", "raw", F.col("_bad").alias("bad")))
    rows = rows.join(found, ["host", "raw"], "left")
    own = F.when((F.col("_bad") == 1) | (F.col("_bad").isNull() & (F.col("purity") >= reject)), "block").otherwise("allow")
    return rows.withColumn("rule", F.col("_rule.rule")).withColumn("verdict", own).drop("_rule", "_bad", "raw")


def op2_url_filter_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls_by_tree(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def level_sql(level: int) -> str:
    """``merge_level`` in SQL, from table t<level> to t<level + 1>."""
    n = level
    return f"""
c{n} AS (SELECT host, segs[1:{n}] AS up, segs[{n + 1}] AS seg, sum(lab) AS lab, sum(bad) AS bad, sum(n) AS n, sum(n * len(segs)) AS deep
         FROM t{n} WHERE len(segs) > {n} GROUP BY 1, 2, 3),
a{n} AS (SELECT *, sum(lab) OVER w AS all_lab, sum(bad) OVER w AS all_bad, sum(n) OVER w AS all_n, sum(deep) OVER w AS all_deep, count(*) OVER w AS branches
         FROM c{n} WINDOW w AS (PARTITION BY host, up)),
z{n} AS (SELECT *, abs((bad + 0.5::DOUBLE) / (lab + 1) - (all_bad - bad + 0.5::DOUBLE) / (all_lab - lab + 1))
                / sqrt((all_bad + 1)::DOUBLE / (all_lab + 2) * (1 - (all_bad + 1)::DOUBLE / (all_lab + 2)) * (1 / (lab + 1)::DOUBLE + 1 / (all_lab - lab + 1)::DOUBLE)) AS z
         FROM a{n}),
m{n} AS (SELECT host, up, seg FROM z{n}
         WHERE branches > 1 AND (lab > 0) = (all_lab - lab > 0) AND z < {SIMILAR_Z}
           AND abs(deep::DOUBLE / n - (all_deep - deep)::DOUBLE / (all_n - n)) < {SIMILAR_DEPTH} AND seg NOT IN ('{{n}}', '{{h}}', '{{v}}', '**')),
t{n + 1} AS (SELECT t.host, t.raw, t.n, t.lab, t.bad, t.own_lab, t.own_bad, t.form_lab, t.form_bad,
                    CASE WHEN m.seg IS NULL THEN t.segs ELSE list_concat(list_concat(t.segs[1:{n}], ['*']), t.segs[{n + 2}:]) END AS segs
             FROM t{n} t LEFT JOIN m{n} m ON t.host = m.host AND t.segs[1:{n}] = m.up AND t.segs[{n + 1}] = m.seg)"""


def shrunk_sql(bad: str, lab: str, towards: str | float) -> str:
    return f"(({bad})::DOUBLE + {PRIOR_WEIGHT}::DOUBLE * {towards}::DOUBLE) / (({lab})::DOUBLE + {PRIOR_WEIGHT}::DOUBLE)"


def oracle() -> str:
    by_length = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in by_length)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in by_length)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {rule} END AS rule, [CASE WHEN regexp_matches(s, '^[0-9]+(\\.[A-Za-z0-9]{{1,5}})?$') THEN '{{n}}' WHEN regexp_matches(s, '^[0-9a-fA-F-]{{8,}}$') THEN '{{h}}'
             WHEN regexp_matches(s, '[0-9]') OR length(s) > {LONG_SEGMENT} THEN '{{v}}' ELSE s END for s in string_split(path, '/') if s <> ''] AS parts FROM h),
v AS (SELECT *, CASE {verdict} END AS said, CASE WHEN len(parts) > {MAX_DEPTH} THEN list_concat(parts[1:{MAX_DEPTH}], ['**']) ELSE parts END AS raw FROM r),
b AS (SELECT *, (said = 'block')::INTEGER AS bad FROM v),
own AS (SELECT host, raw, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0) AS bad FROM b GROUP BY 1, 2),
form AS (SELECT raw, sum(lab) AS form_lab, sum(bad) AS form_bad FROM own GROUP BY 1),
t0 AS (SELECT own.host, own.raw, own.raw AS segs, n, lab AS own_lab, bad AS own_bad, form_lab, form_bad, CASE WHEN form_lab > 0 THEN n ELSE lab END AS lab,
              bad + CASE WHEN form_lab > 0 AND 2 * form_bad >= form_lab THEN n - lab ELSE 0 END AS bad FROM own JOIN form ON own.raw = form.raw),{",".join(map(level_sql, range(MAX_DEPTH)))},
every AS (SELECT {shrunk_sql("coalesce(sum(bad), 0)", "coalesce(sum(lab), 0)", PRIOR)} AS p_all FROM own),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, sum(lab) AS lab, sum(bad) AS bad FROM own GROUP BY 1, 2),
domains AS (SELECT domain, {shrunk_sql("sum(bad)", "sum(lab)", "p_all")} AS p_domain FROM hosts, every GROUP BY domain, p_all),
place AS (SELECT host, {shrunk_sql("bad", "lab", "p_domain")} AS p_host FROM hosts JOIN domains ON hosts.domain = domains.domain),
sums AS (SELECT host, segs, sum(own_lab) AS lab, sum(own_bad) AS bad, sum(form_lab) AS form_lab, sum(form_bad) AS form_bad FROM t{MAX_DEPTH} GROUP BY 1, 2),
p AS (SELECT sums.host, segs, {shrunk_sql("bad", "lab", f"((p_host + {shrunk_sql('form_bad', 'form_lab', 'p_all')}) / 2)")} AS purity FROM sums JOIN place ON sums.host = place.host, every)
SELECT b.page_id, b.host, b.path, b.rule, CASE WHEN said IS NOT NULL THEN said WHEN purity >= {REJECT_PURITY} THEN 'block' ELSE 'allow' END AS verdict,
       '/' || array_to_string(p.segs, '/') AS template, purity
FROM b JOIN t{MAX_DEPTH} t ON b.host = t.host AND b.raw = t.raw JOIN p ON p.host = t.host AND p.segs = t.segs
"""


ORACLE = oracle()
