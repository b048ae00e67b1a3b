"""Registered web-traffic queries."""

from __future__ import annotations

from ..operators import journey as JO
from ..operators import traffic as TR
from . import canonical as K
from .oracle import CTES, pick
from .registry import register

DOMESTIC = "NATION_0"

CTES["sessions_c"] = ([], f"""
    WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day,
                      arg_min(struct_pack(event_type := event_type, event_id := event_id),
                              struct_pack(us := epoch_us(ts), event_id := event_id)) AS first,
                      count(*) AS events, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us
               FROM events GROUP BY 1, 2)
    SELECT user_id, day, first.event_type AS channel, {pick(TR.DEVICES, 'first.event_id')} AS device,
           n_name AS country, events, events > 1 AS engaged, duration_us
    FROM s LEFT JOIN nation ON n_nationkey = user_id % 25""")


def _sess(spark, sf):
    t = K.canon(spark, sf).t
    return TR.sessions(t.events, t.nation)


@register("traffic_by_channel", """
    SELECT channel, count(*) AS sessions,
           round(count_if(engaged)::DOUBLE / count(*)::DOUBLE * 100.0, 2) AS engagement_rate,
           sum(duration_us)::DOUBLE / count(*)::DOUBLE / 1e6 AS avg_engagement_sec
    FROM sessions_c GROUP BY 1""", "sessions_c")
def traffic_by_channel(spark, sf):
    return TR.by_channel(_sess(spark, sf))


COUNTRY_SQL = """
    SELECT country, count(*) AS sessions, count_if(engaged) AS engaged_sessions,
           round(count_if(engaged)::DOUBLE / count(*)::DOUBLE * 100.0, 2) AS engagement_rate,
           round(count(*)::DOUBLE / (SELECT count(*) FROM sessions_c)::DOUBLE * 100.0, 2) AS share
    FROM sessions_c GROUP BY 1"""


@register("traffic_by_country", COUNTRY_SQL, "sessions_c")
def traffic_by_country(spark, sf):
    return TR.by_country(_sess(spark, sf))


@register("domestic_share", f"""
    SELECT round(count_if(country = '{DOMESTIC}')::DOUBLE / count(*)::DOUBLE * 100.0, 2) AS domestic_pct,
           round(100.0 - round(count_if(country = '{DOMESTIC}')::DOUBLE / count(*)::DOUBLE * 100.0, 2), 2)
             AS foreign_pct
    FROM sessions_c""", "sessions_c")
def domestic_share(spark, sf):
    return TR.domestic_share(_sess(spark, sf), DOMESTIC)


@register("suspicious_traffic", f"""
    WITH c AS ({COUNTRY_SQL})
    SELECT coalesce(round(sum(share), 2), 0.0) AS suspicious_share, count(*) AS countries
    FROM c WHERE engagement_rate < 10.0""", "sessions_c")
def suspicious_traffic(spark, sf):
    return TR.suspicious(TR.by_country(_sess(spark, sf)))


@register("device_share", """
    SELECT device, count(*) AS sessions,
           round(count(*)::DOUBLE / (SELECT count(*) FROM sessions_c)::DOUBLE * 100.0, 2) AS share
    FROM sessions_c GROUP BY 1""", "sessions_c")
def device_share(spark, sf):
    return TR.by_device(_sess(spark, sf))


@register("top_pages", """
    WITH v AS (SELECT event_id % (SELECT count(*) FROM pages) AS page_id FROM events WHERE event_type = 'view')
    SELECT url, count(*) AS views FROM v JOIN pages USING (page_id)
    GROUP BY page_id, url ORDER BY views DESC, url LIMIT 10""")
def top_pages(spark, sf):
    t = K.canon(spark, sf).t
    return TR.top_pages(t.events, t.pages)


@register("funnel", """
    WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL),
    f0 AS (SELECT user_id, min(t) AS t FROM e WHERE event_type = 'view' GROUP BY 1),
    f1 AS (SELECT user_id, min(e.t) AS t FROM e JOIN f0 USING (user_id) WHERE event_type = 'click' AND e.t >= f0.t GROUP BY 1),
    f2 AS (SELECT user_id, min(e.t) AS t FROM e JOIN f1 USING (user_id) WHERE event_type = 'signup' AND e.t >= f1.t GROUP BY 1),
    f3 AS (SELECT user_id, min(e.t) AS t FROM e JOIN f2 USING (user_id) WHERE event_type = 'purchase' AND e.t >= f2.t GROUP BY 1)
    SELECT 'view' AS step, count(*) AS users FROM f0 UNION ALL SELECT 'click', count(*) FROM f1
    UNION ALL SELECT 'signup', count(*) FROM f2 UNION ALL SELECT 'purchase', count(*) FROM f3""")
def funnel(spark, sf):
    return JO.funnel(K.canon(spark, sf).t.events)


@register("journey_transitions", """
    WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_type AS s,
                      CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS k
               FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    p AS (SELECT s, k, t, lead(s) OVER w AS s2, lead(t) OVER w AS t2 FROM e WHERE k IS NOT NULL
          WINDOW w AS (PARTITION BY user_id ORDER BY t, k)),
    g AS (SELECT s, s2, count(*) AS n, sum(t2 - t)::BIGINT AS gap FROM p WHERE s2 IS NOT NULL GROUP BY 1, 2)
    SELECT s AS from_step, s2 AS to_step, n AS transitions, n::DOUBLE / sum(n) OVER (PARTITION BY s)::DOUBLE AS share,
           gap::DOUBLE / n::DOUBLE / 1e6 AS mean_gap_sec FROM g""")
def journey_transitions(spark, sf):
    return JO.transitions(K.canon(spark, sf).t.events)
