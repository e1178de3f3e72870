"""URL verdicts by rules and, beyond them, by trust that spreads over host links.

Hosts with pages that rules allow are trusted seeds, hosts with pages that rules
block are blocked seeds, each with the number of such pages. Trust spreads by
personalised PageRank along links from host to host, distrust along the reversed
links. A host is blocked if its distrust exceeds ``RATIO`` times its trust.

Links are those of the pages' HTML to other hosts, counted, and one each way
between a host and the domain above it.

Mass is counted in whole units, so that sums do not depend on their order and
every engine finds the same verdicts. Rounds are the usual power iteration from the
seeds' own part, in which mass only grows; they end once ``ROUNDS_PER_TABLE`` rounds
have added less than a ``SETTLED``-th of one kind's mass.

Cases: a null url or one without ``://`` has empty host and path, no links and no
rule, and is allowed, as is every host that neither trust nor distrust reaches. A
null html has no links. Repeated rows count each. No pages give no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import written_table

# Rules as (verdict, host, path): hosts with all their subdomains, paths from their start.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UNITS = 10**15
DAMPING = 85  # percent
ROUNDS_PER_TABLE = 4
SETTLED = 10_000
RATIO = 1
# Links of one host that go through one task together.
HOT_LINKS = 100_000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _longest_first(rules):
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, and the ``rule`` and ``ruling`` of the longest rule that fits."""
    marked = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in reversed(_longest_first(rules)):
        own_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = own_host & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        ruling = F.when(fits, verdict).otherwise(ruling)
    return marked.withColumns({"rule": rule, "ruling": ruling})


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; ``pages`` have ``host`` and ``html``."""
    own = pages.where("host != ''")
    linked = own.select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"),
    ).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    labels = own.select("host").distinct().select(F.split("host", "[.]").alias("labels"))
    steps = labels.where(F.size("labels") > 2).select(
        "labels", F.explode(F.sequence(F.lit(1), F.size("labels") - 2)).alias("i")
    )
    rest = F.size("labels")
    below = F.array_join(F.slice("labels", F.col("i"), rest), ".")
    above = F.array_join(F.slice("labels", F.col("i") + 1, rest), ".")
    domains = steps.select(below.alias("src"), above.alias("dst")).distinct()
    both = domains.union(domains.select("dst", "src"))
    return linked.union(both).where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, settled: int = SETTLED) -> DataFrame:
    """(kind, host, mass) once settled: seeds (kind, host, n) spread over links (kind, src, dst, n).

    The driver sees one total per written table. A host with very many links is cut into parts, so its links spread over tasks.
    """
    hosts = links.groupBy("kind", "src").agg(
        F.sum("n").alias("total"), F.ceil(F.count("*") / HOT_LINKS).cast("int").alias("parts")
    )
    hosts = written_table(hosts.withColumnRenamed("src", "host"), "link-hosts")
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    cut = written_table(
        links.join(hosts.withColumnRenamed("host", "src").drop("total"), ["kind", "src"])
        .select("kind", F.col("src").alias("host"), part.alias("part"), "dst", "n"),
        "links",
    )
    sums = {r.kind: r.n for r in seeds.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    unit = F.lit(0).cast("long")
    for kind, n in sums.items():
        unit = F.when(F.col("kind") == kind, F.lit(UNITS // n)).otherwise(unit)
    start = seeds.select("kind", "host", (unit * F.col("n")).alias("mass"))
    fresh = start.select("kind", "host", F.expr(f"mass * {100 - DAMPING} div 100").alias("mass"))
    fresh = written_table(fresh, "seeds")
    mass, before = fresh, 0
    for i in itertools.count():
        if i % ROUNDS_PER_TABLE == 0:
            mass = written_table(mass, "mass") if i else mass
            total = mass.agg(F.sum("mass")).first()[0] or 0
            if total - before < UNITS // settled:
                return mass
            before = total
        shares = mass.join(hosts, ["kind", "host"]).select(
            "kind", "host", F.expr(f"mass * {DAMPING} div (100 * total)").alias("share"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        )
        moved = cut.join(shares, ["kind", "host", "part"]).select(
            "kind", F.col("dst").alias("host"), (F.col("share") * F.col("n")).alias("mass")
        )
        mass = fresh.union(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def judge(pages: DataFrame, rules=RULES, settled: int = SETTLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust)"""
    marked = ruled(pages.select("page_id", F.col("url").cast("string").alias("url"), "html"), rules)
    links = written_table(host_links(marked), "host-links")
    forward = links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    backward = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    kind = F.when(F.col("ruling") == "allow", "trust").otherwise("distrust")
    seeds = (
        marked.where("ruling IS NOT NULL AND host != ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))
    )
    mass = propagate(forward.union(backward), seeds, settled)
    scores = written_table(
        mass.groupBy("host").agg(
            *[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0)).alias(k) for k in ("trust", "distrust")]
        ),
        "host-scores",
    )
    joined = marked.drop("html", "url").join(scores, "host", "left").fillna(0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > RATIO * F.col("trust"), "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), "trust", "distrust"
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case_sql(column: int) -> str:
    whens = "".join(
        f" WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(v, h + p)[column]}'"
        for v, h, p in _longest_first(RULES)
    )
    return f"CASE{whens} END"


SQL = f"""
WITH RECURSIVE urls AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, {_quoted(URL)}, 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, {_quoted(URL)}, 2), '') AS path FROM pages),
marked AS (SELECT *, {_case_sql(1)} AS rule, {_case_sql(0)} AS ruling FROM urls),
labels AS (SELECT DISTINCT string_split(host, '.') AS l FROM marked WHERE host != ''),
steps AS (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels WHERE len(l) > 2),
domains AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM steps),
found AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, {_quoted(LINK)}, 1)), '{_UPPER}', '{_LOWER}') AS dst
  FROM marked WHERE host != ''
  UNION ALL SELECT src, dst FROM domains UNION ALL SELECT dst, src FROM domains),
links AS (SELECT src, dst, count(*) AS n FROM found WHERE src != dst GROUP BY src, dst),
edges AS (
  SELECT kind, src, dst, n, CAST(sum(n) OVER (PARTITION BY kind, src) AS BIGINT) AS total FROM (
    SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links)),
seeds AS (
  SELECT CASE WHEN ruling = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n
  FROM marked WHERE ruling IS NOT NULL AND host != '' GROUP BY 1, 2),
fresh AS (
  SELECT kind, host, {UNITS} // CAST(sum(n) OVER (PARTITION BY kind) AS BIGINT) * n * {100 - DAMPING} // 100 AS mass
  FROM seeds),
rounds AS (
  SELECT 0 AS i, kind, host, CAST(mass AS BIGINT) AS mass, CAST(0 AS HUGEINT) AS before FROM fresh
  UNION ALL (
    WITH now AS (SELECT *, sum(mass) OVER () AS total FROM rounds),
    going AS (
      SELECT i, kind, host, mass, CASE WHEN i % {ROUNDS_PER_TABLE} = 0 THEN total ELSE before END AS before
      FROM now WHERE i % {ROUNDS_PER_TABLE} != 0 OR total - before >= {UNITS // SETTLED})
    SELECT i + 1, kind, host, CAST(sum(mass) AS BIGINT), CAST(before AS HUGEINT) FROM (
      SELECT g.i, f.kind, f.host, f.mass, g.before FROM fresh f, (SELECT DISTINCT i, before FROM going) g
      UNION ALL SELECT g.i, e.kind, e.dst, g.mass * {DAMPING} // (100 * total) * n, g.before
      FROM going g JOIN edges e ON g.kind = e.kind AND g.host = e.src)
    GROUP BY i, kind, host, before)),
scores AS (
  SELECT host, CAST(sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS BIGINT) AS trust,
    CAST(sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS BIGINT) AS distrust
  FROM rounds WHERE i = (SELECT max(i) FROM rounds) GROUP BY host)
SELECT page_id, p.host, path, rule,
  coalesce(ruling, CASE WHEN coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM marked p LEFT JOIN scores s ON p.host = s.host
"""
