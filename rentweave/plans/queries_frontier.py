"""Queries over crawl planning and its book-keeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier
from .catalog import query
from .queries_registry import SEARCHES_SQL, searches_view
from .views import AS_OF, ntz, table

_SOURCES = ["sublet_pages", "building_pages"]


def discovered_view(spark, sf_dir):
    """Pages as discovered urls of two sources."""
    return table(spark, sf_dir, "pages").select(
        F.when(F.col("url").startswith("https"), "building_pages").otherwise("sublet_pages").alias("source"),
        "url",
        F.col("page_id").alias("seq"),
    )


def listed_view(spark, sf_dir):
    """Urls that are postings already: every page on one of the hosts."""
    found = discovered_view(spark, sf_dir)
    return found.filter(F.contains("url", F.lit(".example.net"))).select("source", F.col("url").alias("source_url"))


_FOUND_SQL = """
found AS (SELECT CASE WHEN url LIKE 'https%' THEN 'building_pages' ELSE 'sublet_pages' END AS source, url, page_id AS seq FROM pages),
listed AS (SELECT source, url FROM found WHERE contains(url, '.example.net')),
fresh AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.source = f.source AND l.url = f.url))"""


@query(f"WITH {_FOUND_SQL} SELECT * FROM fresh")
def unseen_urls(spark, sf_dir):
    return frontier.unseen_urls(discovered_view(spark, sf_dir), listed_view(spark, sf_dir))


@query(f"WITH {_FOUND_SQL} SELECT * FROM found f WHERE EXISTS (SELECT 1 FROM listed l WHERE l.source = f.source AND l.url = f.url)")
def known_urls(spark, sf_dir):
    return frontier.known_urls(discovered_view(spark, sf_dir), listed_view(spark, sf_dir))


@query(f"WITH {_FOUND_SQL} SELECT source, url FROM found EXCEPT SELECT source, url FROM listed")
def url_difference(spark, sf_dir):
    fresh = frontier.unseen_urls(discovered_view(spark, sf_dir), listed_view(spark, sf_dir))
    return fresh.select("source", "url").distinct()


_ID_SQL = r"""coalesce(nullif(regexp_extract(url, '/(\d+)/', 1), ''), nullif(regexp_extract(url, '/building/(.+)$', 1), ''))
       AS source_listing_id"""


@query(f"""
WITH {_FOUND_SQL},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY seq, url) AS BIGINT) AS place FROM fresh)
SELECT source, url, seq, place, {_ID_SQL} FROM r WHERE place <= 30 ORDER BY source, place LIMIT 45
""")
def frontier_plan(spark, sf_dir):
    plan = frontier.plan_frontier(discovered_view(spark, sf_dir), listed_view(spark, sf_dir), attempted=155)
    return plan.withColumn("place", F.col("place").cast("bigint"))


_HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"


@query(f"""
WITH v AS (SELECT url, page_id, {_HOST_SQL} AS host,
                  row_number() OVER (PARTITION BY {_HOST_SQL} ORDER BY page_id, url) AS visit FROM pages)
SELECT url, host, (visit - 1) * CASE WHEN host LIKE 'blog.%' THEN 1200 ELSE 1000 END AS start_ms FROM v
""")
def host_schedule(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("seq"))
    delay = F.when(F.col("host").startswith("blog."), F.lit(1200)).otherwise(F.lit(1000))
    planned = frontier.host_schedule(urls, delay)
    return planned.select("url", "host", F.col("start_ms").cast("bigint").alias("start_ms"))


_QUERY_SQL = """concat_ws(' ', 'NYC apartment for rent', nullif(borough, ''), nullif(neighborhood, ''),
       CASE WHEN max_rent <> 0 THEN 'under $' || max_rent END,
       CASE WHEN min_beds <> 0 THEN regexp_replace(CAST(min_beds AS VARCHAR), '\\.0$', '') || ' bedroom' END,
       CASE WHEN no_fee_preferred THEN 'no fee' END,
       CASE WHEN length(prompt) > 0 AND length(prompt) < 200 THEN prompt END)"""
_TASKS_SQL = f"""
s AS ({SEARCHES_SQL}),
tasks AS (SELECT search_id, unnest(['sublet_pages', 'building_pages']) AS source, {_QUERY_SQL} AS query FROM s WHERE is_active)"""


@query(f"WITH {_TASKS_SQL} SELECT * FROM tasks")
def discovery_query_text(spark, sf_dir):
    return frontier.plan_searches(searches_view(spark, sf_dir), _SOURCES)


# Each page is found by the search of the customer with the page's number.
@query(f"""
WITH {_TASKS_SQL}, {_FOUND_SQL},
f AS (SELECT lpad(CAST(seq % 40 AS VARCHAR), 20, '0') AS search_id, source, url, seq FROM fresh),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY search_id, source ORDER BY seq, url) AS BIGINT) AS place FROM f)
SELECT r.search_id, r.source, url, seq, place, query, {_ID_SQL}
FROM r JOIN tasks t ON t.search_id = r.search_id AND t.source = r.source WHERE place <= 2
""")
def targeted_plan(spark, sf_dir):
    found = discovered_view(spark, sf_dir).withColumn("search_id", F.lpad((F.col("seq") % 40).cast("string"), 20, "0"))
    tasks = frontier.plan_searches(searches_view(spark, sf_dir), _SOURCES)
    plan = frontier.plan_targeted(tasks, found, listed_view(spark, sf_dir), cap=2)
    return plan.withColumn("place", F.col("place").cast("bigint"))


def jobs_view(spark, sf_dir):
    """A job for every query that asks for no fee, some of them paused."""
    tasks = frontier.plan_searches(searches_view(spark, sf_dir), _SOURCES)
    number = F.col("search_id").cast("bigint")
    return tasks.filter(F.contains("query", F.lit("no fee"))).select(
        F.concat(F.lit("job-"), F.col("search_id"), F.lit("-"), F.col("source")).alias("job_id"),
        "source", F.lit("user_targeted").alias("mode"), "query",
        F.when(number % 8 == 0, "paused").otherwise("active").alias("status"),
        (10 + number % 30).alias("target_count"), (number % 5).alias("discovered"), (number % 4).alias("ingested"),
        (number % 3).alias("units_added"), ntz("2001-01-01 00:00:00").alias("created_at"), ntz("2001-01-01 00:00:00").alias("updated_at"),
    )


_JOBS_SQL = f"""{_TASKS_SQL},
jobs AS (SELECT 'job-' || search_id || '-' || source AS job_id, source, query, CAST(search_id AS BIGINT) AS n,
                CASE WHEN CAST(search_id AS BIGINT) % 8 = 0 THEN 'paused' ELSE 'active' END AS status
         FROM tasks WHERE contains(query, 'no fee'))"""


@query(f"""
WITH {_JOBS_SQL}, a AS (SELECT source, query, min(job_id) AS job_id FROM jobs WHERE status = 'active' GROUP BY 1, 2)
SELECT t.search_id, t.source, t.query,
       coalesce(a.job_id, sha256('job' || chr(1) || 'user_targeted' || chr(1) || t.source || chr(1) || t.query)) AS job_id,
       a.job_id IS NULL AS is_new
FROM tasks t LEFT JOIN a ON a.source = t.source AND a.query = t.query
""")
def job_lookup(spark, sf_dir):
    tasks = frontier.plan_searches(searches_view(spark, sf_dir), _SOURCES)
    return frontier.assign_jobs(tasks, jobs_view(spark, sf_dir))


_DELTA_SQL = """
d AS (SELECT 'job-' || lpad(CAST(c_custkey - c_custkey % 10 AS VARCHAR), 20, '0') || '-sublet_pages' AS job_id, count(*) AS discovered,
             count(*) FILTER (c_custkey % 3 <> 0) AS ingested, count(*) FILTER (c_custkey % 5 = 0) AS units_added,
             max(c_custkey) AS ending_units FROM customer GROUP BY 1)"""


def _deltas(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("job-"), F.lpad((key - key % 10).cast("string"), 20, "0"), F.lit("-sublet_pages")).alias("job_id"),
        F.lit(1).cast("bigint").alias("discovered"),
        (key % 3 != 0).cast("bigint").alias("ingested"),
        (key % 5 == 0).cast("bigint").alias("units_added"),
        key.alias("ending_units"),
    )


@query(f"""
WITH {_JOBS_SQL}, {_DELTA_SQL}
SELECT j.job_id, n % 5 + coalesce(d.discovered, 0) AS discovered, n % 4 + coalesce(d.ingested, 0) AS ingested,
       n % 3 + coalesce(d.units_added, 0) AS units_added
FROM jobs j LEFT JOIN d ON d.job_id = j.job_id
""")
def job_counters(spark, sf_dir):
    """Counters of targeted jobs: the run's counts are added."""
    jobs = frontier.add_job_counts(jobs_view(spark, sf_dir), _deltas(spark, sf_dir))
    return jobs.select("job_id", "discovered", "ingested", "units_added")


@query(f"""
WITH {_JOBS_SQL}, a AS (SELECT source, query, min(job_id) AS job_id FROM jobs WHERE status = 'active' GROUP BY 1, 2),
given AS (
    SELECT coalesce(a.job_id, sha256('job' || chr(1) || 'user_targeted' || chr(1) || t.source || chr(1) || t.query)) AS job_id,
           CAST(t.search_id AS BIGINT) AS s
    FROM tasks t LEFT JOIN a ON a.source = t.source AND a.query = t.query),
d AS (SELECT job_id, count(*) * 3 AS discovered, sum(s % 3) AS ingested, count(*) FILTER (s % 5 = 0) AS units_added FROM given GROUP BY 1),
opened AS (
    SELECT job_id, n % 5 AS discovered, n % 4 AS ingested, n % 3 AS units_added, status FROM jobs
    UNION ALL SELECT job_id, 0, 0, 0, 'active' FROM d WHERE job_id NOT IN (SELECT job_id FROM jobs))
SELECT o.job_id, status, CAST(o.discovered + coalesce(d.discovered, 0) AS BIGINT) AS discovered,
       CAST(o.ingested + coalesce(d.ingested, 0) AS BIGINT) AS ingested,
       CAST(o.units_added + coalesce(d.units_added, 0) AS BIGINT) AS units_added, d.job_id IS NOT NULL AS updated
FROM opened o LEFT JOIN d ON d.job_id = o.job_id
""")
def opened_job_counters(spark, sf_dir):
    """Tasks get their jobs, jobs not seen before get a row, then the run is counted."""
    jobs = jobs_view(spark, sf_dir)
    given = frontier.assign_jobs(frontier.plan_searches(searches_view(spark, sf_dir), _SOURCES), jobs)
    number = F.col("search_id").cast("bigint")
    counts = given.select(
        "job_id", F.lit(3).cast("bigint").alias("discovered"), (number % 3).alias("ingested"),
        (number % 5 == 0).cast("bigint").alias("units_added"),
    )
    opened = frontier.open_jobs(given, jobs, ntz("2001-01-01 00:00:00"))
    counted = frontier.add_job_counts(opened, counts, ntz(AS_OF))
    return counted.select(
        "job_id", "status", "discovered", "ingested", "units_added", (F.col("updated_at") == ntz(AS_OF)).alias("updated")
    )


@query(f"""
WITH {_JOBS_SQL}, {_DELTA_SQL}
SELECT j.job_id, coalesce(d.discovered, n % 5) AS discovered, coalesce(d.ingested, n % 4) AS ingested,
       coalesce(d.units_added, n % 3) AS units_added,
       CASE WHEN d.job_id IS NULL THEN j.status WHEN ending_units >= 10 + n % 30 THEN 'paused' ELSE 'active' END AS status
FROM jobs j LEFT JOIN d ON d.job_id = j.job_id
""")
def registry_job_counters(spark, sf_dir):
    """Counters of registry jobs: replaced, and a job at its target pauses."""
    totals = _deltas(spark, sf_dir).groupBy("job_id").agg(
        *[F.sum(c).alias(c) for c in ("discovered", "ingested", "units_added")], F.max("ending_units").alias("ending_units")
    ).withColumn("updated_at", ntz(AS_OF))
    jobs = frontier.set_job_counts(jobs_view(spark, sf_dir), totals)
    return jobs.select("job_id", "discovered", "ingested", "units_added", "status")


@query(f"""
WITH {_FOUND_SQL}
SELECT (SELECT count(*) FROM customer) AS starting_units, (SELECT count(*) FROM found) AS discovered,
       (SELECT count(*) FROM fresh) AS new_urls, (SELECT count(*) FILTER (seq % 7 <> 0) FROM fresh) AS ingested,
       (SELECT count(*) FILTER (seq % 7 = 0) FROM fresh) AS errors,
       (SELECT count(*) FILTER (seq % 3 = 0) FROM fresh) AS units_added,
       (SELECT count(*) FROM customer) + (SELECT count(*) FILTER (seq % 3 = 0) FROM fresh) AS ending_units
""")
def run_stats(spark, sf_dir):
    found = discovered_view(spark, sf_dir)
    fresh = frontier.unseen_urls(found, listed_view(spark, sf_dir))
    return frontier.run_stats(
        discovered=found,
        fresh=fresh,
        ingested=fresh.withColumn("error", F.when(F.col("seq") % 7 == 0, "malformed json")),
        units_before=table(spark, sf_dir, "customer"),
        links=fresh.withColumn("founds_unit", F.col("seq") % 3 == 0),
    )


