"""Independent SQL restatements of the pipeline for the DuckDB oracle.

The oracle states the *meaning* of each stage with plain SQL over the driver's
views (self-joins with date inequalities, row_number, group by), not the
DataFrame plan used on Spark. Final projections map NaN/inf to NULL and round
doubles to 6 places, as the Spark side does.
"""

from __future__ import annotations


def r6(expr: str) -> str:
    """Non-finite -> NULL; then 9 dp (absorbs float noise) -> 6 dp half-even, IEEE arithmetic."""
    x = f"CAST({expr} AS DOUBLE)"
    v = f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"
    return f"(round_even(round_even({v} * 1e9, 0) / 1e3, 0) / 1e6)"


def fdiv(a: str, b: str) -> str:
    """IEEE division on doubles (x/0 = +-inf, 0/0 = NaN)."""
    return (
        f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL "
        f"WHEN CAST({b} AS DOUBLE) = 0 THEN (CASE WHEN CAST({a} AS DOUBLE) = 0 THEN 'nan'::DOUBLE "
        f"WHEN CAST({a} AS DOUBLE) > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END) "
        f"ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"
    )


RACES = """
races AS (
  SELECT o.o_orderkey AS race_number,
         CAST(o.o_orderdate AS DATE) AS race_date,
         'N' || CAST(c.c_nationkey AS VARCHAR) AS track,
         CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) || '_N' || CAST(c.c_nationkey AS VARCHAR) || '_R' || CAST(o.o_orderkey AS VARCHAR) AS race_id,
         CAST(880 + 110 * (o.o_orderkey % 12) AS BIGINT) AS distance_yards,
         CASE WHEN o.o_orderstatus = 'O' THEN 'T' ELSE 'D' END AS surface,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN 'Hurdle'
              WHEN o.o_orderstatus = 'P' THEN 'All Weather Track'
              WHEN o.o_orderstatus = 'O' THEN 'Turf' ELSE 'Dirt' END AS course_desc,
         CAST(o.o_totalprice AS DOUBLE) AS purse,
         CAST(60 + (floor(o.o_totalprice / 1000) % 60) AS DOUBLE) AS race_class_rating,
         CASE o.o_orderkey % 4 WHEN 0 THEN '3U' WHEN 1 THEN '02' WHEN 2 THEN '34' ELSE NULL END AS age_restriction,
         CASE o.o_orderkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'D' ELSE NULL END AS sex_restriction
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)"""

LINE1 = """
line1 AS (
  SELECT * EXCLUDE (dup_rank) FROM (
    SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_partkey
                                   ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS dup_rank
    FROM lineitem l) WHERE dup_rank = 1
)"""

BASE = """
base AS MATERIALIZED (
  SELECT r.race_id, r.race_date, r.track, r.race_number, r.distance_yards, r.surface, r.course_desc, r.purse,
         r.race_class_rating, r.age_restriction, r.sex_restriction,
         count(*) OVER (PARTITION BY r.race_id) AS num_runners,
         'H' || CAST(x.l_partkey AS VARCHAR) AS horse_name,
         row_number() OVER (PARTITION BY r.race_id ORDER BY x.l_linenumber, x.l_partkey) AS post_position,
         row_number() OVER (PARTITION BY r.race_id ORDER BY x.l_extendedprice * (1 - x.l_discount) DESC, x.l_partkey) AS official_finish,
         CASE WHEN x.l_linenumber = 7 AND x.l_returnflag = 'N' THEN 0.0 ELSE x.l_quantity / 2 END AS dollar_odds,
         x.l_quantity / 2 * (1 + x.l_discount - x.l_tax) AS morning_line_odds_float,
         CASE WHEN x.l_tax > 0.075 THEN NULL ELSE 50.0 + floor(x.l_extendedprice / 2500) END AS speed_figure,
         112.0 + (x.l_suppkey % 14) AS weight_carried,
         CAST(p.p_size * 10 AS DOUBLE) AS entry_class_rating,
         CASE x.l_partkey % 5 WHEN 0 THEN 'G' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'C' ELSE 'H' END AS sex,
         CAST(year(r.race_date) - 2 - (x.l_partkey % 6) AS BIGINT) AS year_of_birth
  FROM line1 x JOIN races r ON x.l_orderkey = r.race_number JOIN part p ON x.l_partkey = p.p_partkey
)"""

# all prior runs of the same horse on strictly earlier days (self-join), newest first
PP = """
pp AS MATERIALIZED (
  SELECT * FROM (
    SELECT b.race_id, b.horse_name,
           row_number() OVER (PARTITION BY b.race_id, b.horse_name ORDER BY h.race_date DESC, h.race_number DESC) AS pp_index,
           h.race_date AS pp_race_date, h.race_number AS pp_race_number, h.track AS pp_track,
           h.speed_figure AS pp_speed_figure, h.official_finish AS pp_official_finish,
           h.num_runners AS pp_num_starters, h.dollar_odds AS pp_odds, h.distance_yards AS pp_distance_yards,
           h.surface AS pp_surface
    FROM base b JOIN base h ON h.horse_name = b.horse_name AND h.race_date < b.race_date
  ) WHERE pp_index <= 10
)"""

PP_ROLL = """
pp_roll AS (
  SELECT race_id, horse_name,
    max(CASE WHEN pp_index = 1 THEN pp_speed_figure END) AS speed_fig_L1,
    max(CASE WHEN pp_index = 2 THEN pp_speed_figure END) AS speed_fig_L2,
    max(CASE WHEN pp_index = 3 THEN pp_speed_figure END) AS speed_fig_L3,
    avg(CASE WHEN pp_index <= 3 THEN pp_speed_figure END) AS avg_speed_fig_L3,
    max(CASE WHEN pp_index <= 3 THEN pp_speed_figure END) AS max_speed_fig_L3,
    max(CASE WHEN pp_index = 1 THEN pp_official_finish END) AS official_finish_L1,
    max(CASE WHEN pp_index = 2 THEN pp_official_finish END) AS official_finish_L2,
    max(CASE WHEN pp_index = 3 THEN pp_official_finish END) AS official_finish_L3,
    max(CASE WHEN pp_index = 1 THEN pp_num_starters END) AS num_starters_L1,
    max(CASE WHEN pp_index = 2 THEN pp_num_starters END) AS num_starters_L2,
    max(CASE WHEN pp_index = 3 THEN pp_num_starters END) AS num_starters_L3,
    max(CASE WHEN pp_index = 1 THEN pp_odds END) AS pp_odds_L1,
    max(CASE WHEN pp_index = 2 THEN pp_odds END) AS pp_odds_L2,
    max(CASE WHEN pp_index = 3 THEN pp_odds END) AS pp_odds_L3,
    max(CASE WHEN pp_index = 1 THEN pp_distance_yards END) AS distance_yards_L1,
    max(CASE WHEN pp_index = 2 THEN pp_distance_yards END) AS distance_yards_L2,
    max(CASE WHEN pp_index = 3 THEN pp_distance_yards END) AS distance_yards_L3,
    max(CASE WHEN pp_index = 1 THEN pp_surface END) AS pp_surface_L1,
    max(CASE WHEN pp_index = 1 THEN pp_race_date END) AS last_pp_date,
    count(*) AS num_prior_starts
  FROM pp GROUP BY race_id, horse_name
)"""

PP_FEATS = f"""
pp_feats AS (
  SELECT *,
    (relative_finish_L1 + relative_finish_L2 + relative_finish_L3) / 3 AS avg_relative_finish,
    ((1 - relative_finish_L1) - {fdiv('1', 'pp_odds_L1 + 1')}
     + (1 - relative_finish_L2) - {fdiv('1', 'pp_odds_L2 + 1')}
     + (1 - relative_finish_L3) - {fdiv('1', 'pp_odds_L3 + 1')}) / 3 AS pp_avg_overperformance_L3,
    (1 - relative_finish_L1) - {fdiv('1', 'pp_odds_L1 + 1')} AS pp_overperformance_L1,
    (1 - relative_finish_L2) - {fdiv('1', 'pp_odds_L2 + 1')} AS pp_overperformance_L2,
    (1 - relative_finish_L3) - {fdiv('1', 'pp_odds_L3 + 1')} AS pp_overperformance_L3
  FROM (
    SELECT *,
      {fdiv('official_finish_L1', 'num_starters_L1')} AS relative_finish_L1,
      {fdiv('official_finish_L2', 'num_starters_L2')} AS relative_finish_L2,
      {fdiv('official_finish_L3', 'num_starters_L3')} AS relative_finish_L3,
      speed_fig_L1 - avg_speed_fig_L3 AS speed_fig_trend
    FROM pp_roll)
)"""

WORKOUTS = f"""
wk AS (
  SELECT 'H' || CAST(l_partkey AS VARCHAR) AS horse_name, CAST(l_shipdate AS DATE) AS workout_date,
         CAST(l_linenumber AS BIGINT) AS workout_ranking, CAST(CAST(l_quantity AS INTEGER) % 12 AS BIGINT) AS workout_num_in_group,
         l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2,
         {fdiv('l_linenumber', 'CAST(l_quantity AS INTEGER) % 12')} AS pct
  FROM lineitem WHERE l_returnflag = 'A'
),
wk_hist AS (
  SELECT b.race_id, b.horse_name, w.*  EXCLUDE (horse_name),
         row_number() OVER (PARTITION BY b.race_id, b.horse_name ORDER BY w.pct, w.workout_date, w.k1, w.k2) AS best_rank,
         row_number() OVER (PARTITION BY b.race_id, b.horse_name ORDER BY w.workout_date DESC, w.k1 DESC, w.k2 DESC) AS last_rank
  FROM base b JOIN wk w ON w.horse_name = b.horse_name AND w.workout_date < b.race_date
),
wk_feats AS (
  SELECT race_id, horse_name,
         min(pct) AS best_workout_rank_pct,
         max(CASE WHEN best_rank = 1 THEN workout_num_in_group END) AS best_workout_group_size,
         max(CASE WHEN last_rank = 1 THEN pct END) AS last_workout_rank_pct,
         max(CASE WHEN last_rank = 1 THEN workout_num_in_group END) AS last_workout_group_size,
         count(*) AS num_workouts,
         max(workout_date) AS last_workout_date
  FROM wk_hist GROUP BY race_id, horse_name
)"""

CAREER = """
career AS MATERIALIZED (
  SELECT b.race_id, b.horse_name,
    count(h.race_id) AS career_starts,
    count(CASE WHEN h.official_finish = 1 THEN 1 END) AS career_wins,
    count(CASE WHEN h.official_finish = 2 THEN 1 END) AS career_seconds,
    count(CASE WHEN h.official_finish = 3 THEN 1 END) AS career_thirds,
    CAST(coalesce(sum(CAST(floor(h.purse * CASE h.official_finish WHEN 1 THEN 0.6 WHEN 2 THEN 0.2 WHEN 3 THEN 0.1 ELSE 0.0 END) AS BIGINT)), 0) AS DOUBLE) AS career_earnings,
    count(CASE WHEN h.surface = b.surface THEN 1 END) AS surface_starts,
    count(CASE WHEN h.surface = b.surface AND h.official_finish = 1 THEN 1 END) AS surface_wins,
    count(CASE WHEN h.surface = b.surface AND h.official_finish = 2 THEN 1 END) AS surface_seconds,
    count(CASE WHEN h.surface = b.surface AND h.official_finish = 3 THEN 1 END) AS surface_thirds
  FROM base b LEFT JOIN base h ON h.horse_name = b.horse_name AND h.race_date < b.race_date
  GROUP BY b.race_id, b.horse_name
)"""

RAW = """
raw AS (
  SELECT b.race_id, b.race_date, b.track, b.race_number, b.distance_yards, b.surface, b.course_desc, b.num_runners,
         b.horse_name, b.official_finish, b.dollar_odds, b.race_class_rating,
         b.morning_line_odds_float, b.post_position, b.weight_carried, b.purse, b.year_of_birth, b.sex,
         b.age_restriction, b.sex_restriction,
         c.career_starts, c.career_wins, c.career_seconds, c.career_thirds, c.career_earnings,
         c.surface_starts, c.surface_wins, c.surface_seconds, c.surface_thirds,
         b.entry_class_rating,
         p.* EXCLUDE (race_id, horse_name, num_prior_starts),
         coalesce(p.num_prior_starts, 0) AS num_prior_starts,
         w.* EXCLUDE (race_id, horse_name, num_workouts),
         coalesce(w.num_workouts, 0) AS num_workouts,
         b.num_runners AS field_size,
         CAST(b.official_finish = 1 AS INTEGER) AS won,
         b.morning_line_odds_float AS live_odds
  FROM base b
  JOIN career c ON c.race_id = b.race_id AND c.horse_name = b.horse_name
  LEFT JOIN pp_feats p ON p.race_id = b.race_id AND p.horse_name = b.horse_name
  LEFT JOIN wk_feats w ON w.race_id = b.race_id AND w.horse_name = b.horse_name
  WHERE b.course_desc NOT IN ('Hurdle', 'Downhill turf', 'Timber') AND b.dollar_odds > 0
)"""

DERIVED = f"""
derived AS MATERIALIZED (
  SELECT *,
    CAST(course_type = 'All Weather Track' AS INTEGER) AS is_all_weather,
    CAST(course_type = 'Dirt' AS INTEGER) AS is_dirt,
    CAST(course_type = 'Turf' AS INTEGER) AS is_turf,
    CAST(course_type <> pp_course_type AS INTEGER) AS surface_switch_L1,
    {fdiv('entry_class_rating', 'race_class_rating')} AS entry_to_race_class_ratio,
    CAST(year(race_date) - year_of_birth AS BIGINT) AS age,
    CAST(sex IN ('F', 'M') AS INTEGER) AS is_female,
    CAST(sex = 'G' AS INTEGER) AS is_gelded,
    CASE WHEN {fdiv('post_position', 'field_size')} <= 1.0 / 3 THEN 0
         WHEN {fdiv('post_position', 'field_size')} <= 2.0 / 3 THEN 1 ELSE 2 END AS post_position_bucket,
    CASE WHEN age_restriction IS NULL THEN NULL
         WHEN substr(age_restriction, 1, 1) = '0' THEN TRY_CAST(substr(replace(age_restriction, 'U', '9'), 2, 1) AS INTEGER)
         ELSE TRY_CAST(substr(age_restriction, 1, 1) AS INTEGER) END AS min_age_allowed,
    CASE WHEN age_restriction IS NULL THEN NULL
         WHEN substr(age_restriction, 2, 1) = 'U' THEN 99
         ELSE TRY_CAST(substr(age_restriction, 2, 1) AS INTEGER) END AS max_age_allowed,
    CAST(sex_restriction IS NOT NULL AS INTEGER) AS is_sex_restricted,
    CAST(coalesce(sex_restriction IN ('B', 'F', 'M'), false) AS INTEGER) AS is_female_only_race,
    CAST(coalesce(sex_restriction IN ('A', 'C', 'G', 'H', 'I', 'J', 'R'), false) AS INTEGER) AS is_male_only_race,
    CAST(race_date - last_pp_date AS BIGINT) AS days_since_last,
    CAST(race_date - last_workout_date AS BIGINT) AS days_since_last_workout,
    distance_yards - distance_yards_L1 AS distance_diff_L1,
    distance_yards - distance_yards_L2 AS distance_diff_L2,
    distance_yards - distance_yards_L3 AS distance_diff_L3,
    entry_class_rating - avg(entry_class_rating) OVER (PARTITION BY race_id) AS entry_class_rating_minus_field_avg,
    {fdiv('entry_class_rating', 'avg(entry_class_rating) OVER (PARTITION BY race_id)')} AS entry_class_rating_to_field_avg_ratio,
    speed_fig_L1 - avg(speed_fig_L1) OVER (PARTITION BY race_id) AS speed_fig_minus_field_avg_L1,
    {fdiv('speed_fig_L1', 'avg(speed_fig_L1) OVER (PARTITION BY race_id)')} AS speed_fig_to_field_avg_ratio_L1,
    {fdiv('career_wins', 'career_starts')} AS career_win_rate,
    {fdiv('career_wins + career_seconds + career_thirds', 'career_starts')} AS career_top3_rate,
    {fdiv('career_earnings', 'career_starts')} AS career_earnings_per_start,
    {fdiv('surface_wins', 'surface_starts')} AS surface_win_rate,
    {fdiv('surface_wins + surface_seconds + surface_thirds', 'surface_starts')} AS surface_top3_rate,
    CASE WHEN morning_line_odds_float IS NULL THEN NULL
         ELSE rank() OVER (PARTITION BY race_id ORDER BY morning_line_odds_float ASC NULLS LAST) END AS ml_odds_rank,
    CASE WHEN live_odds IS NULL THEN NULL
         ELSE rank() OVER (PARTITION BY race_id ORDER BY live_odds ASC NULLS LAST) END AS live_odds_rank,
    {fdiv('1', 'live_odds + 1')} / sum({fdiv('1', 'live_odds + 1')}) OVER (PARTITION BY race_id) AS market_prob
  FROM (
    SELECT *,
      CASE WHEN course_desc = 'All Weather Track' THEN 'All Weather Track'
           WHEN surface = 'D' THEN 'Dirt' WHEN surface = 'T' THEN 'Turf' END AS course_type,
      CASE WHEN pp_surface_L1 IN ('T', 'I', 'O') THEN 'Turf' WHEN pp_surface_L1 = 'D' THEN 'Dirt'
           WHEN pp_surface_L1 = 'E' THEN 'All Weather Track' END AS pp_course_type
    FROM raw)
)"""

# fixed linear scorer: logit(clip(market_prob)) + 0.02 * speed gap + 0.005 * class gap
SCORED = """
scored AS (
  SELECT *,
    ln(least(greatest(market_prob, 1e-4), 1 - 1e-4) / (1 - least(greatest(market_prob, 1e-4), 1 - 1e-4)))
      + 0.02 * coalesce(speed_fig_minus_field_avg_L1, 0.0)
      + 0.005 * coalesce(entry_class_rating_minus_field_avg, 0.0) AS model_score
  FROM derived
)"""


def enriched_cte(temperature: float = 1.0) -> str:
    t = repr(float(temperature))
    return f"""
soft0 AS (
  SELECT *, exp(model_score / {t} - max(model_score / {t}) OVER (PARTITION BY race_id)) AS e
  FROM scored
),
soft AS MATERIALIZED (
  SELECT * EXCLUDE (market_prob, e),
    e / sum(e) OVER (PARTITION BY race_id) AS model_prob,
    (1.0 / (dollar_odds + 1)) / sum(1.0 / (dollar_odds + 1)) OVER (PARTITION BY race_id) AS market_prob
  FROM soft0
),
enriched AS MATERIALIZED (
  SELECT *, dollar_odds + 1 AS decimal_odds, model_prob * (dollar_odds + 1) - 1 AS ev_per_dollar
  FROM soft WHERE race_id IN (SELECT race_id FROM soft WHERE won = 1)
)"""


FINAL_ODDS = """
final_odds AS (
  SELECT b.*, CAST(b.official_finish = 1 AS INTEGER) AS won,
         (1.0 / (b.dollar_odds + 1)) / sum(1.0 / (b.dollar_odds + 1)) OVER (PARTITION BY b.race_id) AS market_prob
  FROM base b
  WHERE b.course_desc NOT IN ('Hurdle', 'Downhill turf', 'Timber') AND b.dollar_odds > 0
),
final_odds_w AS (
  SELECT * FROM final_odds WHERE race_id IN (SELECT race_id FROM final_odds WHERE won = 1)
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


HISTORY_CTES = (RACES, LINE1, BASE, PP, PP_ROLL, PP_FEATS, WORKOUTS, CAREER)
MODEL_CTES = HISTORY_CTES + (RAW, DERIVED, SCORED)

OVERRIDES = """
overrides AS (
  SELECT race_id, race_number, post_position, horse_name, race_class_rating,
         CASE WHEN race_number % 53 = 0 AND post_position = 2
              THEN printf('%d:%02d PM', 1 + race_number % 9, ((race_number * 7) % 60 + 1) % 60)
              ELSE printf('%d:%02d PM', 1 + race_number % 9, (race_number * 7) % 60) END AS post_time,
         CASE WHEN post_position = 3 AND race_number % 3 = 0 THEN NULL ELSE entry_class_rating END AS entry_class_rating,
         speed_figure AS speed_fig_L1, speed_figure - 2 AS speed_fig_L2,
         CASE WHEN race_number % 4 = 0 THEN NULL ELSE speed_figure - 4 END AS speed_fig_L3
  FROM base WHERE NOT (race_number % 97 = 0 AND post_position = 1)
  UNION ALL
  SELECT race_id, race_number, max(num_runners) + 1, NULL, max(race_class_rating),
         printf('%d:%02d PM', 1 + race_number % 9, (race_number * 7) % 60), NULL, NULL, NULL, NULL
  FROM base WHERE race_number % 89 = 0 GROUP BY race_id, race_number
)"""

# card events folded in (ts, seq) order per race with a recursive CTE (bit mask of scratched posts)
CARD_FOLD = """
ev AS (
  SELECT user_id AS race_key, CAST(event_id % 8 + 1 AS BIGINT) AS post_position, ts, event_id AS seq,
         1::BIGINT << (event_id % 8) AS bit,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'odds' WHEN event_type = 'error' THEN 'scratch'
              WHEN event_type = 'signup' THEN 'unscratch' END AS kind,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN value / 10 END AS live_odds,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events
),
cards AS (
  SELECT race_number AS race_key, sum(1::BIGINT << (post_position - 1))::BIGINT AS posts
  FROM base WHERE race_number IN (SELECT race_key FROM ev) GROUP BY race_number HAVING count(*) >= 2
),
card AS (
  SELECT race_number AS race_key, post_position, morning_line_odds_float AS default_odds
  FROM base JOIN cards ON cards.race_key = race_number
),
fold AS (
  WITH RECURSIVE f(race_key, i, posts, mask, accepted) AS (
    SELECT DISTINCT ev.race_key, CAST(0 AS BIGINT), coalesce(posts, 0)::BIGINT, 0::BIGINT, NULL::BOOLEAN FROM ev LEFT JOIN cards USING (race_key)
    UNION ALL
    SELECT e.race_key, e.i, f.posts,
      CASE WHEN e.kind = 'scratch' AND (f.posts & ~f.mask & bit) <> 0 AND bit_count(f.posts & ~f.mask) >= 3 THEN f.mask | bit
           WHEN e.kind = 'unscratch' AND (f.mask & bit) <> 0 THEN f.mask & ~bit
           ELSE f.mask END,
      CASE WHEN e.kind = 'scratch' THEN (f.posts & ~f.mask & bit) <> 0 AND bit_count(f.posts & ~f.mask) >= 3
           WHEN e.kind = 'unscratch' THEN (f.mask & bit) <> 0
           WHEN e.kind = 'odds' THEN (f.posts & ~f.mask & bit) <> 0
           ELSE false END
    FROM f JOIN ev e ON e.race_key = f.race_key AND e.i = f.i + 1
  )
  SELECT e.*, f.posts, f.mask, f.accepted FROM ev e JOIN f ON f.race_key = e.race_key AND f.i = e.i
)"""

#: The log with cards that come and go; ``fold`` has a race's state before its log as i = 0.
LIFE_FOLD = """
raw AS (
  SELECT user_id, event_id AS seq, ts, event_id % 8 + 1 AS post,
    CASE WHEN event_type = 'view' AND event_id % 500 = 7 THEN 'delete_all' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'create'
         WHEN event_type = 'click' AND event_id % 5 = 1 THEN 'delete' WHEN event_type = 'error' THEN 'scratch'
         WHEN event_type = 'signup' THEN 'unscratch' ELSE 'odds' END AS kind, value / 10 AS live_odds
  FROM events
),
cards AS (
  SELECT race_number AS race_key, sum(1::BIGINT << (post_position - 1))::BIGINT AS posts
  FROM base WHERE race_number IN (SELECT user_id FROM raw) GROUP BY race_number
),
lev AS (
  SELECT user_id AS race_key, r.seq, r.ts, r.kind, CASE WHEN r.kind NOT IN ('create', 'delete') THEN post END AS post_position,
    CASE WHEN r.kind NOT IN ('create', 'delete') THEN 1::BIGINT << (post - 1) ELSE 0 END AS bit, live_odds,
    CASE WHEN r.kind = 'create' THEN CASE WHEN r.seq % 3 = 0 THEN coalesce(posts, 0) & 7 ELSE coalesce(posts, 0) END ELSE 0 END AS offered,
    (SELECT count(*) FROM raw c WHERE c.kind = 'delete_all' AND (c.ts < r.ts OR (c.ts = r.ts AND c.seq < r.seq))) AS cleared,
    row_number() OVER (PARTITION BY user_id ORDER BY r.ts, r.seq) AS i
  FROM raw r LEFT JOIN cards ON race_key = user_id WHERE r.kind <> 'delete_all'
),
fold AS (
  WITH RECURSIVE f AS (
    SELECT u.race_key, 0::BIGINT AS i, coalesce(bit_count(posts) >= 2 AND u.race_key % 2 = 0, false) AS alive,
      CASE WHEN bit_count(posts) >= 2 AND u.race_key % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS version,
      CASE WHEN bit_count(posts) >= 2 AND u.race_key % 2 = 0 THEN posts ELSE 0 END::BIGINT AS posts, 0::BIGINT AS mask, 0::BIGINT AS cleared, NULL::VARCHAR AS reason
    FROM (SELECT DISTINCT user_id AS race_key FROM raw) u LEFT JOIN cards USING (race_key)
    UNION ALL
    SELECT race_key, i, CASE WHEN reason IS NULL AND kind = 'create' THEN true WHEN reason IS NULL AND kind = 'delete' THEN false ELSE here END,
      version + CASE WHEN reason IS NULL AND kind = 'create' THEN 1 ELSE 0 END,
      CASE WHEN reason IS NULL AND kind = 'create' THEN offered ELSE posts END,
      CASE WHEN reason IS NOT NULL THEN mask WHEN kind = 'create' THEN 0 WHEN kind = 'scratch' THEN mask | bit WHEN kind = 'unscratch' THEN mask & ~bit ELSE mask END,
      cleared, reason
    FROM (
      SELECT *, CASE
        WHEN kind = 'create' THEN CASE WHEN here THEN 'already exists' WHEN bit_count(offered) < 2 THEN 'fewer than 2 runners' END
        WHEN NOT here THEN 'unknown race' WHEN kind = 'delete' THEN NULL WHEN (posts & bit) = 0 THEN 'unknown post'
        WHEN kind = 'scratch' THEN CASE WHEN (mask & bit) <> 0 THEN 'already scratched' WHEN bit_count(posts & ~mask) < 3 THEN 'too few active runners' END
        WHEN kind = 'unscratch' THEN CASE WHEN (mask & bit) = 0 THEN 'not scratched' END
        WHEN (mask & bit) <> 0 THEN 'scratched' END AS reason
      FROM (SELECT e.race_key, e.i, e.kind, e.bit, e.offered, e.cleared, f.alive AND e.cleared = f.cleared AS here, f.version, f.posts, f.mask
            FROM f JOIN lev e ON e.race_key = f.race_key AND e.i = f.i + 1))
  )
  SELECT f.*, e.seq, e.ts, e.kind, e.post_position, e.live_odds FROM f LEFT JOIN lev e ON e.race_key = f.race_key AND e.i = f.i
)"""

