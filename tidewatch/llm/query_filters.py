"""op13: interaction audit of five filters over all documents, in all orders."""

from tidewatch.llm import filters
from tidewatch.llm.base import query, table

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
 FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
w AS (SELECT rid, doc_id, part, t, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT rid, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS "A", CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS "B",
 CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 1 ELSE 0 END AS "C",
 CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS "D", CASE WHEN w.doc_id > first THEN 1 ELSE 0 END AS "E",
 coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, {{'A': "A", 'B': "B", 'C': "C", 'D': "D", 'E': "E"}} AS s, "A" + "B" + "C" + "D" + "E" AS fails, good, toxic, count(*) AS n
 FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c c, c d, c e
 WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
st AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, filter_order[:step - 1] AS before FROM o, range(1, 6) r(step)),
m AS (SELECT part, filter_order, step, x, n, good, toxic, fails,
 CASE x WHEN 'A' THEN s."A" WHEN 'B' THEN s."B" WHEN 'C' THEN s."C" WHEN 'D' THEN s."D" ELSE s."E" END AS own,
 CASE WHEN s."A" = 1 AND contains(before, 'A') OR s."B" = 1 AND contains(before, 'B') OR s."C" = 1 AND contains(before, 'C')
  OR s."D" = 1 AND contains(before, 'D') OR s."E" = 1 AND contains(before, 'E') THEN 1 ELSE 0 END AS gone FROM g, st),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN own = 0 AND gone = 0 THEN n ELSE 0 END) AS kept,
 sum(CASE WHEN own = 1 AND gone = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN own = 1 AND gone = 1 THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN own = 1 AND gone = 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
 sum(CASE WHEN own = 1 AND gone = 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost FROM m GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""


@query("op13_filters", SQL)
def op13_filters(spark, sf):
    return filters.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))
