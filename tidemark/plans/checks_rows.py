"""Queries: row selection, reshaping, simple aggregates, dates and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import rates, text_time as T
from tidemark.operators import composites, counts, defense, evaluate, reshape, rows
from tidemark.plans import bindings as B, featuresql as FS, sqlparts as S
from tidemark.plans.registry import big, epoch, query, rnd


@query("pa_end_filter", B.with_ctes(
    f"SELECT batter, count(*) AS n FROM d_pitches WHERE events IN {S.in_list(K.PA_ENDING_EVENTS)} GROUP BY 1", "d_pitches"))
def pa_end_filter(spark, d):
    return rows.pa_end_filter(B.pitches(spark, d)).groupBy("batter").agg(F.count(F.lit(1)).alias("n"))


@query("modal_value", """
    SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
    FROM events GROUP BY 1, 2) WHERE rn = 1""")
def modal_value(spark, d):
    return counts.modal_value(B.table(spark, d, "events"), ["user_id"], "event_type")


@query("latest_non_null", "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def latest_non_null(spark, d):
    return counts.latest_non_null(B.table(spark, d, "events"), ["user_id"], "event_type", "ts")


@query("keep_last", """
    SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_date FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def keep_last(spark, d):
    df = rows.keep_last(B.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return df.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_date"))


@query("keep_first", """
    SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_date FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def keep_first(spark, d):
    df = rows.keep_first(B.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return df.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_date"))


@query("top_n_per_group", """
    SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
    WHERE rank <= 15""")
def top_n_per_group(spark, d):
    df = rows.top_n(B.table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 15, "rank")
    return df.select("p_brand", "p_partkey", "p_retailprice", big("rank").alias("rank"))


@query("semi_join_items", """
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o
    ON l_orderkey = o_orderkey GROUP BY 1""")
def semi_join_items(spark, d):
    done = B.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return B.table(spark, d, "lineitem").join(done, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("anti_join_orders", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def anti_join_orders(spark, d):
    items = B.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return rows.without(B.table(spark, d, "orders"), items, ["o_orderkey"]).select("o_orderkey")


@query("replace_batch", """
    SELECT o_orderkey, 'history' AS source FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)
    UNION ALL SELECT o_orderkey, 'batch' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""")
def replace_batch(spark, d):
    o = B.table(spark, d, "orders")
    big_items = B.table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    batch = o.join(big_items, "o_orderkey", "left_semi").select("o_orderkey", F.lit("batch").alias("source"))
    history = o.select("o_orderkey", F.lit("history").alias("source"))
    return rows.replace_batch(history, batch, ["o_orderkey"])


@query("tagged_union", """
    SELECT status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
      SELECT 'done' AS status, o_totalprice FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'open', o_totalprice FROM orders WHERE o_orderstatus = 'O'
      UNION ALL SELECT 'partial', o_totalprice FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def tagged_union(spark, d):
    o = B.table(spark, d, "orders")
    both = rows.tagged_union({"done": o.where("o_orderstatus = 'F'"), "open": o.where("o_orderstatus = 'O'"), "partial": o.where("o_orderstatus = 'P'")}, "status")
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_RAW_SQL = """SELECT CAST(floor(game_id / 2) AS BIGINT) AS game_id, game_id AS raw_id, game_date, status, game_type,
  CASE WHEN game_id % 50 = 7 THEN 'TBD' ELSE CAST(home_score AS VARCHAR) END AS home_score, CAST(away_score AS VARCHAR) AS away_score FROM d_games"""


@query("clean_outcomes", B.with_ctes(f"""
    SELECT game_id, raw_id, game_date, hs AS home_score, aws AS away_score, hs > aws AS home_win, hs - aws AS run_diff, hs + aws AS total_runs,
      game_type IN ('F', 'D', 'L', 'W') AS is_postseason
    FROM (SELECT *, TRY_CAST(home_score AS BIGINT) AS hs, TRY_CAST(away_score AS BIGINT) AS aws,
            row_number() OVER (PARTITION BY game_id ORDER BY game_date DESC, raw_id DESC) AS rn
          FROM ({_RAW_SQL}) WHERE status IN ('Final', 'Completed Early') AND game_type IN ('R', 'F', 'D', 'L', 'W')) WHERE rn = 1""", "d_games"))
def clean_outcomes(spark, d):
    g = B.games(spark, d)
    raw = g.select(
        F.floor(F.col("game_id") / 2).alias("game_id"), F.col("game_id").alias("raw_id"), "game_date", "status", "game_type",
        F.when(F.col("game_id") % 50 == 7, "TBD").otherwise(F.col("home_score").cast("string")).alias("home_score"),
        F.col("away_score").cast("string").alias("away_score"))
    return rows.clean_outcomes(raw, tie=["raw_id"]).drop("status", "game_type")


@query("status_counts", B.with_ctes(
    "SELECT season_year, CASE WHEN game_type = 'S' THEN 'Unknown' ELSE status END AS status, count(*) AS n FROM d_games GROUP BY 1, 2", "d_games"))
def status_counts(spark, d):
    g = B.games(spark, d).withColumn("status", F.when(F.col("game_type") != "S", F.col("status")))
    return counts.status_counts(g, ["season_year"]).select(big("season_year").alias("season_year"), "status", "n")


@query("home_records", B.with_ctes(
    "SELECT home_name, count(*) AS home_games, round(avg((home_score > away_score)::INT), 3) + 0.0 AS home_win_pct FROM d_games GROUP BY 1", "d_games"))
def home_records(spark, d):
    return counts.home_records(B.games(spark, d).withColumn("home_win", F.col("home_score") > F.col("away_score")))


@query("home_advantage_by_season", B.with_ctes(f"""
    SELECT CAST(season_year AS BIGINT) AS season_year, count(*) AS n, {S.rounded(['home_mean', 'away_mean', 'diff', 'home_win_rate']).replace('home_mean AS DOUBLE', 'avg(home_score) AS DOUBLE').replace('away_mean AS DOUBLE', 'avg(away_score) AS DOUBLE').replace('(diff AS', '(avg(home_score) - avg(away_score) AS').replace('home_win_rate AS DOUBLE', 'avg((home_score > away_score)::INT) AS DOUBLE')}
    FROM d_games GROUP BY season_year""", "d_games"))
def home_advantage_by_season(spark, d):
    df = counts.home_advantage_by_season(B.games(spark, d))
    return df.select(big("season_year").alias("season_year"), "n", *[rnd(c).alias(c) for c in ("home_mean", "away_mean", "diff", "home_win_rate")])


@query("explode_lineups", B.with_ctes(
    """SELECT game_id, side, row_number() OVER (PARTITION BY game_id, side ORDER BY slot) AS slot, player_id, position FROM d_long""", "d_long"))
def explode_lineups(spark, d):
    df = reshape.explode_lineups(B.lineups_wide(spark, d))
    return df.select("game_id", "side", big("slot").alias("slot"), "player_id", "position")


@query("lineup_composite", B.with_ctes(
    f"""SELECT game_id, side, round(sum(v * w) / nullif(sum(w) FILTER (WHERE v IS NOT NULL), 0), 9) + 0.0 AS v,
      round(sum(p * w) / sum(w), 9) + 0.0 AS p
    FROM (SELECT *, CASE WHEN player_id % 5 <> 0 THEN (player_id % 97)::DOUBLE END AS v, (player_id % 13)::DOUBLE AS p,
            [{', '.join(repr(w) for w in K.SLOT_WEIGHTS)}][slot] AS w FROM d_long WHERE slot BETWEEN 1 AND 9) GROUP BY 1, 2""", "d_long"))
def lineup_composite(spark, d):
    long = B.lineups_long(spark, d).withColumns({
        "v": F.when(F.col("player_id") % 5 != 0, (F.col("player_id") % 97).cast("double")), "p": (F.col("player_id") % 13).cast("double")})
    return composites.lineup_composite(long, ["v", "p"]).select("game_id", "side", rnd("v").alias("v"), rnd("p").alias("p"))


@query("staff_composite", """
    SELECT l_orderkey AS game_id, round(CASE WHEN sp IS NULL THEN pen WHEN pen IS NULL THEN sp ELSE w * sp + (1 - w) * pen END, 9) + 0.0 AS metric
    FROM (SELECT l_orderkey, max(l_discount) FILTER (WHERE l_linenumber = 1) AS sp,
            least(greatest(coalesce(max(l_quantity) FILTER (WHERE l_linenumber = 1 AND l_returnflag <> 'A'), 5.5) / 9, 0.25), 0.85) AS w,
            avg(l_discount) FILTER (WHERE l_linenumber > 1) AS pen FROM lineitem GROUP BY 1)""")
def staff_composite(spark, d):
    l = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), "l_linenumber", F.col("l_discount").alias("metric"), "l_quantity", "l_returnflag")
    first = F.col("l_linenumber") == 1
    starters = l.groupBy("game_id").agg(
        F.max(F.when(first, F.col("metric"))).alias("metric"),
        F.max(F.when(first & (F.col("l_returnflag") != "A"), F.col("l_quantity"))).alias("expected_ip"))
    df = composites.staff_composite(starters, l.where("l_linenumber > 1"), ["game_id"], "metric")
    return df.select("game_id", rnd("metric").alias("metric"))


@query("stack_sides", B.with_ctes(
    """SELECT game_id, side, is_home, runs, opponent_runs, off_x, opp_sp_x FROM (
      SELECT game_id, 'home' AS side, 1 AS is_home, home_score::DOUBLE AS runs, away_score::DOUBLE AS opponent_runs, home_id::DOUBLE AS off_x, away_id::DOUBLE AS opp_sp_x FROM d_games
      UNION ALL SELECT game_id, 'away', 0, away_score, home_score, away_id, home_id FROM d_games)""", "d_games"))
def stack_sides(spark, d):
    g = B.games(spark, d).withColumns({"home_off_x": F.col("home_id"), "away_off_x": F.col("away_id"), "home_sp_x": F.col("home_id"), "away_sp_x": F.col("away_id")})
    return reshape.stack_sides(g).select("game_id", "side", big("is_home").alias("is_home"), "runs", "opponent_runs", "off_x", "opp_sp_x")


@query("pivot_sides", B.with_ctes(
    """SELECT game_id, count(*) FILTER (WHERE side = 'home') AS home_n, count(*) FILTER (WHERE side = 'away') AS away_n,
      sum(player_id) FILTER (WHERE side = 'home')::BIGINT AS home_ids, sum(player_id) FILTER (WHERE side = 'away')::BIGINT AS away_ids FROM d_long GROUP BY 1""", "d_long"))
def pivot_sides(spark, d):
    per = B.lineups_long(spark, d).groupBy("game_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("player_id").alias("ids"))
    wide = reshape.fold_sides(per, "game_id", ["n", "ids"])
    return wide.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("home_n", "away_n")})


@query("position_targets", B.with_ctes(
    "SELECT position, round(target, 9) + 0.0 AS target FROM targets", "d_long", "d_oaa", extra=FS.DEFENSE_CTES))
def position_targets(spark, d):
    df = defense.position_targets(defense.starts_by_position(B.lineups_long(spark, d)))
    return df.select("position", rnd("target").alias("target"))


@query("scaled_oaa", B.with_ctes(
    f"SELECT player_id, position, {S.rounded(['oaa', 'oaa_R', 'oaa_L', 'scale'])} FROM soaa", "d_long", "d_oaa", extra=FS.DEFENSE_CTES))
def scaled_oaa(spark, d):
    df = defense.scaled_oaa(B.oaa(spark, d), B.lineups_long(spark, d))
    return df.select("player_id", "position", *[rnd(c).alias(c) for c in ("oaa", "oaa_R", "oaa_L", "scale")])


_DEF = ["def_inf_R", "def_inf_L", "def_of_R", "def_of_L"]


@query("team_defense", B.with_ctes(
    f"SELECT game_id, side, {S.rounded(_DEF)} FROM def", "d_long", "d_oaa", extra={**FS.DEFENSE_CTES, **FS.team_defense_ctes("d_long")}))
def team_defense(spark, d):
    long = B.lineups_long(spark, d)
    df = defense.team_defense(long, defense.scaled_oaa(B.oaa(spark, d), long))
    return df.select("game_id", "side", *[rnd(c).alias(c) for c in _DEF])


@query("first_at_position", B.with_ctes(
    "SELECT game_id, side, position, player_id, CAST(slot AS BIGINT) AS slot FROM firsts", "d_long", extra={"firsts": FS.team_defense_ctes("d_long")["firsts"]}))
def first_at_position(spark, d):
    df = defense.first_at_position(B.lineups_long(spark, d))
    return df.select("game_id", "side", "position", "player_id", big("slot").alias("slot"))


@query("fielding_attempts", B.with_ctes(
    """SELECT player_id, position_abbrev, CAST(round_even(CASE WHEN abs(o) > 0 AND abs(r) > 0 THEN abs(o) / abs(r) END, 0) AS BIGINT) AS attempts
    FROM (SELECT *, outs_above_average AS o, TRY_CAST(rtrim(diff_success_rate_formatted, '%') AS DOUBLE) / 100 AS r FROM d_oaa)""", "d_oaa"))
def fielding_attempts(spark, d):
    df = B.oaa(spark, d)
    return df.select("player_id", "position_abbrev", T.attempts_from_rates(F.col("outs_above_average"), F.col("diff_success_rate_formatted")).alias("attempts"))


@query("team_ids_of_names", """
    SELECT s_suppkey, upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) AS player_name
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def team_ids_of_names(spark, d):
    names = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("player_id"), F.col("n_name").alias("name"))
    s = B.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("pitcher"))
    return rows.attach_names(s, names, "pitcher").select("s_suppkey", "player_name")


@query("attach_hand", B.with_ctes(
    """SELECT game_id, side, coalesce(CASE WHEN game_id % 3 = 0 THEN 'L' END, hand) AS throws FROM (SELECT game_id, side, pitcher_id FROM d_arms WHERE seq = 1)
    LEFT JOIN (SELECT pitcher, arg_max(p_throws, game_date) AS hand FROM d_pitches WHERE p_throws IS NOT NULL GROUP BY 1) ON pitcher_id = pitcher""", "d_pitches", "d_arms"))
def attach_hand(spark, d):
    hands = counts.latest_non_null(B.pitches(spark, d), ["pitcher"], "p_throws", "game_date").select(
        F.col("pitcher").alias("player_id"), F.col("p_throws").alias("hand"))
    sp = B.starters(spark, d).select("game_id", "side", F.col("starter_id").alias("sp"))
    sp = sp.withColumn("throws", F.when(F.col("game_id") % 3 == 0, "L"))
    return rows.attach_hand(sp, hands, id_col="sp", out="throws").select("game_id", "side", "throws")


@query("missing_documents", "SELECT o_orderkey AS game_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_documents(spark, d):
    return rows.missing_documents(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("game_id")),
                                  B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id")))


@query("date_gaps", """
    SELECT CAST(d AS DATE) AS game_date FROM generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) t(d)
    WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def date_gaps(spark, d):
    return rows.date_gaps(B.table(spark, d, "orders").select(F.col("o_orderdate").alias("game_date")), "game_date", "1994-12-01", "2001-12-31")


@query("latest_scorable_date", """
    SELECT max(CAST(o_orderdate AS DATE)) AS game_date FROM orders WHERE o_orderdate <= DATE '2000-06-30'
      AND CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 40)""")
def latest_scorable_date(spark, d):
    o = B.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("game_date"))
    l = B.table(spark, d, "lineitem").where("l_quantity > 40").select(F.to_date("l_shipdate").alias("game_date"))
    return rows.latest_scorable_date(o, l, "2000-06-30")


@query("ny_calendar_date", """
    SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS local_date, count(*) AS n FROM events GROUP BY 1""")
def ny_calendar_date(spark, d):
    ev = B.table(spark, d, "events").select(T.eastern_date(F.col("ts").cast("timestamp")).alias("local_date"))
    return ev.groupBy("local_date").agg(F.count(F.lit(1)).alias("n"))


@query("json_props", "SELECT user_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark, d):
    ev = B.table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return ev.groupBy("user_id").agg(F.sum("p.k").alias("k"))


@query("lenient_cast", """
    SELECT CAST(TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS BIGINT) AS brand_no, TRY_CAST(p_type AS BIGINT) AS type_no, count(*) AS n FROM part GROUP BY 1, 2""")
def lenient_cast(spark, d):
    p = B.table(spark, d, "part").select(
        F.regexp_replace("p_brand", "Brand#", "").try_cast("bigint").alias("brand_no"), F.col("p_type").try_cast("bigint").alias("type_no"))
    return p.groupBy("brand_no", "type_no").agg(F.count(F.lit(1)).alias("n"))


@query("surname_display", "SELECT s_suppkey, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS surname FROM (SELECT s_suppkey, string_split(s_name, '#')[-1] AS w FROM supplier)")
def surname_display(spark, d):
    s = B.table(spark, d, "supplier")
    return s.select("s_suppkey", T.surname(F.translate("s_name", "#", " ")).alias("surname"))


@query("pythag", B.with_ctes(
    """SELECT game_id, round(pow(h, 1.83) / (pow(h, 1.83) + pow(a, 1.83)), 9) + 0.0 AS p, round(pow(h0, 1.83) / (pow(h0, 1.83) + pow(a, 1.83)), 9) + 0.0 AS p0
    FROM (SELECT game_id, CASE WHEN home_score <> 3 THEN greatest(home_score, 1e-9) END::DOUBLE AS h, greatest(away_score, 1e-9)::DOUBLE AS a,
            CASE WHEN home_score <> 3 THEN greatest(home_score, 1e-9) ELSE 1e-9 END::DOUBLE AS h0 FROM d_games)""", "d_games"))
def pythag(spark, d):
    h, a = F.when(F.col("home_score") != 3, F.col("home_score").cast("double")), F.col("away_score").cast("double")
    return B.games(spark, d).select("game_id", rnd(rates.pythag(h, a)).alias("p"), rnd(rates.pythag_zero_filled(h, a)).alias("p0"))


@query("feature_coverage", B.with_ctes(
    """SELECT feature, round(coverage, 9) + 0.0 AS coverage FROM (SELECT avg((woba_value IS NOT NULL)::INT) AS woba_value, avg((bb_type IS NOT NULL)::INT) AS bb_type,
      avg((p_throws IS NOT NULL)::INT) AS p_throws, avg((events IS NOT NULL)::INT) AS events FROM d_pitches)
    UNPIVOT (coverage FOR feature IN (woba_value, bb_type, p_throws, events))""", "d_pitches"))
def feature_coverage(spark, d):
    df = evaluate.feature_coverage(B.pitches(spark, d), ["woba_value", "bb_type", "p_throws", "events"])
    return df.select("feature", rnd("coverage").alias("coverage"))


@query("correlation", "SELECT round(corr(l_quantity, l_extendedprice), 9) + 0.0 AS corr, count(*) AS n FROM lineitem")
def correlation(spark, d):
    df = evaluate.correlation(B.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return df.select(rnd("corr").alias("corr"), "n")


@query("histogram", B.with_ctes(
    "SELECT least(floor(home_score - away_score + 9), 17) - 9.0 AS bin, count(*) AS n FROM d_games GROUP BY 1", "d_games"))
def histogram(spark, d):
    g = B.games(spark, d).withColumn("run_diff", F.col("home_score") - F.col("away_score"))
    return evaluate.histogram(g, "run_diff", -9, 9)


@query("card_arrays", """
    SELECT o_orderkey, w[1] AS starter, coalesce(len(w), 0) > 0 AS filled, coalesce(list_contains(w, 7), FALSE) AS has_seven, coalesce(list_sum(w[1:9]), 0)::BIGINT AS nine, CAST(coalesce(len(w[1:9]), 0) AS BIGINT) AS kept
    FROM orders LEFT JOIN (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS w FROM lineitem WHERE l_quantity > 5 GROUP BY 1) ON l_orderkey = o_orderkey""")
def card_arrays(spark, d):
    """Lists of an order's suppliers as batting cards: first entry, size test, membership, cut to nine; orders without one too."""
    order = F.struct("l_linenumber", "l_suppkey", "l_partkey")
    cards = B.table(spark, d, "lineitem").where(F.col("l_quantity") > 5).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("c"))
    both = B.table(spark, d, "orders").join(cards, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("c.l_suppkey").alias("w"))
    nine = T.first_n(F.col("w"), K.LINEUP_SLOTS)
    total = F.aggregate(F.coalesce(nine, F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return both.select("o_orderkey", T.first_of(F.col("w")).alias("starter"), T.has_any(F.col("w")).alias("filled"),
                       T.holds(F.col("w"), F.lit(7).cast("long")).alias("has_seven"), total.alias("nine"),
                       F.coalesce(F.size(nine), F.lit(0)).cast("long").alias("kept"))
