"""URL filters: explicit rules first, else a reputation learned from labelled pages by empirical Bayes.

Bad outcomes shrink from host to registered domain to suffix: each level's beta prior is centred on the
posterior mean of the level above. Its strength in pseudo-pages is learned too, by moments: how much more the outcomes
of a level's members spread round the rate of the level above than draws at that rate would (1 to 1000; STRENGTH where no
member has two labelled pages). Every host of a page has a posterior, with or without labels of its own. A host is
blocked if the lower bound of its posterior bad rate (mean - z standard deviations) passes `block_above`.

Null or scheme-less urls have an empty host and path: no rule fits them and they share the reputation
of the empty host. Null labels are ignored. Repeated pages are judged one by one and repeated labels
count each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, ascii_lower, read

#: Fixed values of the contract: rule text and verdict.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: Two-label public suffixes; others have one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "com.cn", "co.in", "co.nz", "com.mx")
STRENGTH, Z, BLOCK_ABOVE = 8.0, 1.645, 0.5
WEAKEST, STRONGEST = 1, 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (ties: the smaller text), or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        site, _, tail = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{tail}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*SUFFIXES)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def strength_of(members: DataFrame, n: str, bad: str, rate: Column, name: str) -> DataFrame:
    """One row: the strength of a beta prior round `rate` for members with n outcomes of which bad are bad."""
    draws = F.col(n) * rate * (1 - rate)
    excess, room = F.sum(F.pow(F.col(bad) - F.col(n) * rate, 2) - draws), F.sum(draws * (F.col(n) - 1))
    strength = F.when(excess * (STRONGEST + 1) <= room, F.lit(float(STRONGEST))).otherwise(F.greatest(room / excess - 1, F.lit(float(WEAKEST))))
    return members.filter(F.col(n) > 0).agg(F.when(room > 0, strength).otherwise(F.lit(STRENGTH)).alias(name))


def reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """outcomes(host, bad 0/1) -> host, n, n_bad, bad_mean, bad_bound. Counts are partial sums before the shuffle.

    A null bad counts as no outcome, but its host gets a row: with no outcome of its own, what its domain, suffix and all say."""
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad")).select("*", domain.alias("domain"), suffix.alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("n_bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    world = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("wn"), F.coalesce(F.sum("sb"), F.lit(0)).alias("wb"))
    # one row each: strengths of hosts in domains, domains in suffixes, suffixes in all
    k1 = strength_of(suffixes.join(F.broadcast(world)), "sn", "sb", F.col("wb") / F.col("wn"), "k1")
    k2 = strength_of(domains.join(suffixes, "suffix"), "dn", "db", F.col("sb") / F.col("sn"), "k2")
    k3 = strength_of(hosts.join(domains.drop("suffix"), "domain"), "n", "n_bad", F.col("db") / F.col("dn"), "k3")
    top = suffixes.join(F.broadcast(world)).join(F.broadcast(k1)).select("suffix", ((F.col("sb") + F.col("k1") * (F.col("wb") + 1) / (F.col("wn") + 2)) / (F.col("sn") + F.col("k1"))).alias("m1"))
    mid = domains.join(top, "suffix").join(F.broadcast(k2)).select("domain", ((F.col("db") + F.col("k2") * F.col("m1")) / (F.col("dn") + F.col("k2"))).alias("m2"))
    a, b = F.col("n_bad") + F.col("k3") * F.col("m2"), F.col("n") - F.col("n_bad") + F.col("k3") * (1 - F.col("m2"))
    mean, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(mid, "domain").join(F.broadcast(k3)).select("host", "n", "n_bad", mean.alias("bad_mean"), (mean - z * spread).alias("bad_bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """pages(page_id, url), labels(page_id, bad) -> page_id, host, path, rule, verdict, bad_bound."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = base.select("page_id", "host").join(labels.filter("bad is not null"), "page_id").select("host", "bad")
    every = seen.unionByName(base.select("host").distinct().withColumn("bad", F.lit(None).cast(seen.schema["bad"].dataType)))
    scored = base.join(reputation(every).select("host", "bad_bound"), "host", "left")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    ruled = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) if rules else F.lit(None).cast("map<string,string>")
    scored = scored.select("page_id", "host", "path", rule.alias("rule"), "bad_bound")
    learned = F.when(F.col("bad_bound") > block_above, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(F.element_at(ruled, F.coalesce("rule", F.lit(""))) if rules else F.lit(None).cast("string"), learned))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the label row of the same id; a page is bad if its quality is 0 or it is toxic."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    cases = "\n".join(
        f"    WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for r in sorted(RULES, key=lambda r: (-len(r), r))
    )
    ruled = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    twos = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
o AS (SELECT host, CASE WHEN doc_id IS NULL THEN NULL WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM p LEFT JOIN labels ON doc_id = page_id),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b, string_split(host, '.') AS x FROM o GROUP BY host),
h1 AS (SELECT *, array_to_string(x[-2:], '.') IN ({twos}) AS l2 FROM h0),
h AS (SELECT host, n, b, CASE WHEN l2 THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS dom,
        CASE WHEN l2 THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suf FROM h1),
d AS (SELECT dom, suf, sum(n) AS dn, sum(b) AS db FROM h GROUP BY dom, suf),
s AS (SELECT suf, sum(dn) AS sn, sum(db) AS sb FROM d GROUP BY suf),
w AS (SELECT coalesce(sum(sn), 0) AS wn, coalesce(sum(sb), 0) AS wb FROM s),
m AS (SELECT 1 AS level, sn AS n, sb AS b, wb / wn AS r FROM s, w WHERE sn > 0
      UNION ALL SELECT 2, dn, db, sb / sn FROM d JOIN s USING (suf) WHERE dn > 0
      UNION ALL SELECT 3, n, b, db / dn FROM h JOIN d USING (dom) WHERE n > 0),
v AS (SELECT level, sum((b - n * r) ** 2 - n * r * (1 - r)) AS excess, sum(n * r * (1 - r) * (n - 1)) AS room FROM m GROUP BY level),
k0 AS (SELECT level, CASE WHEN NOT room > 0 THEN {STRENGTH} WHEN excess * {STRONGEST + 1} <= room THEN {STRONGEST} ELSE greatest(room / excess - 1, {WEAKEST}) END AS k FROM v),
k AS (SELECT coalesce(max(k) FILTER (level = 1), {STRENGTH}) AS k1, coalesce(max(k) FILTER (level = 2), {STRENGTH}) AS k2, coalesce(max(k) FILTER (level = 3), {STRENGTH}) AS k3 FROM k0),
s1 AS (SELECT suf, (sb + k1 * (wb + 1) / (wn + 2)) / (sn + k1) AS m1 FROM s, w, k),
d1 AS (SELECT dom, (db + k2 * m1) / (dn + k2) AS m2 FROM d JOIN s1 USING (suf), k),
ab AS (SELECT host, b + k3 * m2 AS a, n - b + k3 * (1 - m2) AS c FROM h JOIN d1 USING (dom), k),
r AS (SELECT host, a / (a + c) - {Z} * sqrt(a * c / ((a + c) * (a + c) * (a + c + 1))) AS bound FROM ab),
q AS (SELECT page_id, host, path, CASE
{cases}
    END AS rule, bound FROM p LEFT JOIN r USING (host))
SELECT page_id, host, path, rule, CASE rule {ruled} ELSE CASE WHEN bound > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END END AS verdict FROM q"""
