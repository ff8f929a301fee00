"""Queries over filters, joins, identity, windows, splits and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import filters as FI
from ..operators import identity as ID
from ..operators import joins as J
from ..operators import reshape as R
from ..operators import windows as W
from .fixture import RAW_SQL, ROSTER_SQL, VALID_SQL, contests, players, raw_contests, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
STAMP = "%Y-%m-%d %H:%M:%S"
TRAIN, VALIDATION = "1999-01-01 00:00:00", "2000-07-01 00:00:00"


def query(name: str, sql: str | None = None):
    """Register a query with its DuckDB SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def at(column: str = "datetime"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("contest_fixture", f"with {RAW_SQL} select match_id, game_id, strftime(datetime, '{STAMP}') as datetime, map_name, is_total, best_of, score1_game, score2_game, team1_id, team2_id, team1_join_key, team2_join_key, team1_win, tournament from named")
def contest_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contests(spark, sf_dir).select("match_id", "game_id", at().alias("datetime"), "map_name", "is_total", "best_of", "score1_game", "score2_game", "team1_id", "team2_id", "team1_join_key", "team2_join_key", "team1_win", "tournament")


@query("valid_contests", f"with {VALID_SQL} select row_id, match_id, game_id, map_name, key1, key2, team1_win from valid")
def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.row_ids(contests(spark, sf_dir)).select("row_id", "match_id", "game_id", "map_name", "key1", "key2", "team1_win")


@query(
    "filter_audit",
    f"""with {VALID_SQL}, f as (select *, map_name is not null as named_, coalesce(bo = 1, false) as one, score1_game + score2_game > 0 as scored from coerced)
select count(*) as n_rows, count(*) filter (not named_) as n_missing_map, count(*) filter (named_ and total and not one) as n_phantom,
 count(*) filter (named_ and not (total and not one) and not scored) as n_non_positive, count(*) filter (named_ and (not total or one) and scored) as n_valid from f""",
)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.filter_audit(FI.coerce_contests(raw_contests(spark, sf_dir)))


@query("bool_coercion", f"with {RAW_SQL} select is_total as spelling, count(*) as n, coalesce(lower(trim(is_total)) in ('true','false','1','0'), true) as readable, coalesce(lower(trim(is_total)) in ('true','1'), false) as as_boolean from named group by is_total")
def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.boolean_spellings(raw_contests(spark, sf_dir), "is_total")


#: Rows that break each rule of the contract, planted among the fixture's.
PLANTED = """planted as (
  select match_id, game_id + case when match_id % 101 = 0 and game_id = 2 then -1 else 0 end as game_id,
    case when match_id % 103 = 0 and game_id > 1 then datetime - interval 1 day when match_id % 107 = 0 then null else datetime end as datetime,
    case when match_id % 109 = 0 then -score1_game else score1_game end as score1_game, score2_game,
    case when match_id % 113 = 0 then null else team1_id end as team1_id, team2_id,
    case when match_id % 127 = 0 then 2 when match_id % 131 = 0 then 1 - team1_win else team1_win end as team1_win
  from named)"""


def _planted(rows: DataFrame) -> DataFrame:
    match, game = F.col("match_id"), F.col("game_id")
    return rows.withColumns(
        {
            "datetime": F.when((match % 103 == 0) & (game > 1), F.col("datetime") - F.expr("interval 1 day")).when(match % 107 != 0, F.col("datetime")),
            "game_id": F.when((match % 101 == 0) & (game == 2), game - 1).otherwise(game),
            "score1_game": F.when(match % 109 == 0, -F.col("score1_game")).otherwise(F.col("score1_game")),
            "team1_id": F.when(match % 113 != 0, F.col("team1_id")),
            "team1_win": F.when(match % 127 == 0, F.lit(2)).when(match % 131 == 0, 1 - F.col("team1_win")).otherwise(F.col("team1_win")),
        }
    )


@query(
    "contract_violations",
    f"""with {RAW_SQL}, {PLANTED}, breaks as (
  select match_id, datetime, lag(datetime) over (partition by match_id order by game_id, datetime) as prior from planted)
select * from (
select 'no_tie' as rule, count(*) filter (not coalesce(score1_game <> score2_game, false)) as n from planted
union all select 'binary_target', count(*) filter (not coalesce(team1_win in (0, 1), false)) from planted
union all select 'ids_present', count(*) filter (match_id is null or game_id is null or team1_id is null or team2_id is null) from planted
union all select 'two_teams', count(*) filter (not coalesce(team1_id <> team2_id, false)) from planted
union all select 'has_time', count(*) filter (datetime is null) from planted
union all select 'score_agrees', count(*) filter (not coalesce((score1_game > score2_game)::int = team1_win, false)) from planted
union all select 'counts_not_negative', count(*) filter (not coalesce(score1_game >= 0 and score2_game >= 0, false)) from planted
union all select 'unique:match_id,game_id', count(*) from (select 1 from planted group by match_id, game_id having count(*) > 1)
union all select 'one:match_id->datetime', count(*) from (select 1 from planted group by match_id having count(distinct datetime) > 1)
union all select 'ordered:datetime', count(*) from breaks where prior > datetime)""",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of broken rules; a game id occurs twice only where it was planted, so the order by game is checked by time within it."""
    rows = _planted(raw_contests(spark, sf_dir))
    contract = FI.contest_contract()
    ordered = contract.ordered_by
    contract.ordered_by = []
    falls = FI.order_breaks(rows.withColumn("at", F.struct("game_id", "datetime")), "at", "datetime", [ordered[0]])
    return contract.violations(rows).unionByName(falls.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ordered:datetime").alias("rule"), "n"))


@query("lenient_boolean", f"with {RAW_SQL} select match_id, game_id, coalesce(is_total <> '', false) as as_boolean from named")
def lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contests(spark, sf_dir).select("match_id", "game_id", S.lenient_boolean(F.col("is_total")).alias("as_boolean"))


@query("rate_ranges", f"with {RAW_SQL} select 'discount' as \"column\", count(*) filter (not (discount * 11 between 0 and 1)) as n from named union all select 'tax', count(*) filter (not (tax between 0 and 1)) from named")
def rate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_contests(spark, sf_dir).withColumns({"discount": F.col("discount") * 11})
    return FI.rates_out_of_range(rows, ["discount", "tax"])


@query("display_names", f"with {RAW_SQL} select match_id, game_id, case map_name when 'map1' then 'Dust' when 'map2' then 'Inferno' else map_name end as shown from named")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contests(spark, sf_dir).select("match_id", "game_id", S.displayed(F.col("map_name"), {"map1": "Dust", "map2": "Inferno"}).alias("shown"))


@query("section_replace", "select page_id, case when strpos(html, '<ul>') > 0 and strpos(substr(html, strpos(html, '<ul>') + 4), '</ul>') > 0 then length(substr(html, 1, strpos(html, '<ul>') + 3)) + 5 + length(substr(html, strpos(html, '<ul>') + 3 + strpos(substr(html, strpos(html, '<ul>') + 4), '</ul>'))) else length(html) end as n_chars from pages")
def section_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's first list replaced by three characters."""
    new = S.replaced_section(F.col("html"), "<ul>", "</ul>", F.lit("new"))
    return read(spark, sf_dir, "pages").select("page_id", F.length(new).cast("long").alias("n_chars"))


@query("allowlist_projection", f"with {VALID_SQL} select match_id, game_id, team1_id, team2_id, tournament, team1, team2, team1_join_key, team2_join_key, map_name, team1_win from valid")
def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FI.allowlist(contests(spark, sf_dir), [c for c in (*FI.IDENTIFIERS, *FI.CONTEXT) if c != "map_id"])
    return FI.assert_no_leaks(rows).drop("datetime")


@query("presence_flags", f"with {RAW_SQL} select match_id, game_id, map_name is not null and is_total is not null as has_map, team1_join_key is not null and team2_join_key is not null as has_keys from named")
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.presence(raw_contests(spark, sf_dir), {"has_map": ["map_name", "is_total"], "has_keys": ["team1_join_key", "team2_join_key"]}).select("match_id", "game_id", "has_map", "has_keys")


@query("diff_features", f"with {VALID_SQL} select match_id, game_id, score1_game - score2_game as round_diff, team1_id - team2_id as id_diff from valid")
def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.differences(contests(spark, sf_dir), {"round_diff": ("score1_game", "score2_game"), "id_diff": ("team1_id", "team2_id")}).select("match_id", "game_id", "round_diff", "id_diff")


@query("cutoff_history", "select event_type, count(*) as n, round(sum(value), 4) as total from events where ts < timestamp '2024-01-15 12:00:00' group by event_type")
def cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.before(read(spark, sf_dir, "events"), "2024-01-15 12:00:00", "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("substring_year_filter", f"with {RAW_SQL} select match_id, game_id, tournament from named where contains(lower(tournament), 'cologne') and extract(year from datetime) = 1998")
def substring_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contests(spark, sf_dir).where(FI.mentions("tournament", "COLOGNE", 1998)).select("match_id", "game_id", "tournament")


@query("unordered_pair_filter", f"with {RAW_SQL} select match_id, game_id, team1_id, team2_id from named where (team1_id = 5 and team2_id = 7) or (team1_id = 7 and team2_id = 5)")
def pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contests(spark, sf_dir).where(FI.is_pair("team1_id", "team2_id", 5, 7)).select("match_id", "game_id", "team1_id", "team2_id")


@query("id_semi_join", "select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return FI.in_ids(read(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey", "o_totalprice")


PROFILE = f"""{VALID_SQL}, profile as (
 select key1 as team, map_name, case when part % 4 = 0 then null else discount * 0.7310585786::double end as rate, part % 3 as weight from valid),
collapsed as (
 select team, map_name, sum(case when rate is not null and weight > 0 then rate * weight end) / nullif(sum(case when rate is not null and weight > 0 then weight else 0 end), 0) as rate,
  sum(case when rate is not null and weight > 0 then weight else 0 end)::bigint as weight from profile group by team, map_name)"""


def _profile(rows: DataFrame) -> DataFrame:
    raw = rows.select(F.col("key1").alias("team"), "map_name", F.when(F.col("part") % 4 != 0, F.col("discount") * 0.7310585786).alias("rate"), (F.col("part") % 3).alias("weight"))
    return A.weighted_collapse(raw, ["team", "map_name"], {"rate": "weight"})


@query("profile_weighted_collapse", f"with {PROFILE} select team, map_name, round(rate, 6) as rate, weight from collapsed")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_profile(contests(spark, sf_dir)), "rate")


@query("profile_join_two_sides", f"with {PROFILE} select match_id, game_id, round(a.rate, 6) as team1_rate, a.weight as team1_weight, round(b.rate, 6) as team2_rate, b.weight as team2_weight from valid v left join collapsed a on a.team = v.key1 and a.map_name = v.map_name left join collapsed b on b.team = v.key2 and b.map_name = v.map_name")
def profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contests(spark, sf_dir)
    return rounded(J.join_both_sides(rows, _profile(rows)).select("match_id", "game_id", "team1_rate", "team1_weight", "team2_rate", "team2_weight"), "team1_rate", "team2_rate")


LINKS = f"""{VALID_SQL},
lefts as (select match_id as id, min(datetime) as t, min(least(key1, key2)) as a, max(greatest(key1, key2)) as b from valid where match_id % 3 = 0 group by match_id having count(*) = 1),
rights as (select match_id as id, min(datetime) + interval 4 hour as t, min(greatest(key1, key2)) as a, max(least(key1, key2)) as b from valid where match_id % 3 <> 0 group by match_id having count(*) = 1),
cand as (select least(l.a, l.b) || '|' || greatest(l.a, l.b) as pair, l.id as left_id, r.id as right_id, abs(epoch_us(l.t) - epoch_us(r.t)) / 3600000000.0::double as gap_hours
 from lefts l join rights r on least(l.a, l.b) = least(r.a, r.b) and greatest(l.a, l.b) = greatest(r.a, r.b) where abs(epoch_us(l.t) - epoch_us(r.t)) <= 2400.0 * 3600000000)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contests(spark, sf_dir).withColumns({"x": F.least("key1", "key2"), "y": F.greatest("key1", "key2")})
    one = rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.min("datetime").alias("t"), F.min("x").alias("a"), F.max("y").alias("b")).where("n = 1")
    left = one.where("match_id % 3 = 0").select(F.col("match_id").alias("id"), F.col("t").alias("time"), "a", "b")
    right = one.where("match_id % 3 <> 0").select(F.col("match_id").alias("id"), (F.col("t") + F.expr("interval 4 hours")).alias("time"), F.col("b").alias("a"), F.col("a").alias("b"))
    return J.band_join(left, right, 2400.0)


@query("pair_time_band_join", f"with {LINKS} select pair, left_id, right_id, round(gap_hours, 6) as gap_hours from cand")
def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_candidates(spark, sf_dir), "gap_hours")


@query(
    "greedy_one_to_one_links",
    f"""with recursive {LINKS},
ranked as (select *, row_number() over (partition by pair order by gap_hours, left_id, right_id) as k from cand),
walk as (
 select pair, k, left_id, right_id, gap_hours, true as taken, [left_id] as used_left, [right_id] as used_right from ranked where k = 1
 union all
 select r.pair, r.k, r.left_id, r.right_id, r.gap_hours, not list_contains(w.used_left, r.left_id) and not list_contains(w.used_right, r.right_id),
  case when not list_contains(w.used_left, r.left_id) and not list_contains(w.used_right, r.right_id) then list_append(w.used_left, r.left_id) else w.used_left end,
  case when not list_contains(w.used_left, r.left_id) and not list_contains(w.used_right, r.right_id) then list_append(w.used_right, r.right_id) else w.used_right end
 from walk w join ranked r on r.pair = w.pair and r.k = w.k + 1)
select pair, left_id, right_id, round(gap_hours, 6) as gap_hours from walk where taken""",
)
def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.greedy_links(_candidates(spark, sf_dir)), "gap_hours")


@query("canonical_identity", f"with {VALID_SQL} select key1 as team, count(*) as n, count(distinct team1_id) as n_ids from valid group by key1")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contests(spark, sf_dir).groupBy(F.col("key1").alias("team")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("team1_id").alias("n_ids"))


ALIASES = f"""{VALID_SQL}, idx as (
 select regexp_replace(lower('Club ' || (team1_id % 40)::varchar), '[^a-z0-9]+', '', 'g') as alias, key1 as key, count(*) as n_maps, max(datetime) as last_seen from valid group by 1, 2),
best as (select alias, key from (select *, row_number() over (partition by alias order by n_maps desc, last_seen desc, key desc) as k from idx) where k = 1),
asked as (select 'club' || i::varchar as alias from range(0, 50) t(i))"""


@query("alias_resolution", f"with {ALIASES} select a.alias, coalesce(b.key, 'name:' || a.alias) as key from asked a left join best b on a.alias = b.alias")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contests(spark, sf_dir)
    index = ID.alias_index(rows, S.ascii_key(F.concat(F.lit("Club "), (F.col("team1_id") % 40).cast("string"))), "key1")
    asked = spark.range(50).select(F.concat(F.lit("club"), F.col("id").cast("string")).alias("alias"))
    return ID.resolve(asked, index, "name:")


@query("entity_status", f"with {VALID_SQL}, seen as (select key1 as key, count(*) as n, max(datetime) as last_seen from valid group by key1) select a.key, coalesce(s.n, 0) as n_games, strftime(s.last_seen, '{STAMP}') as last_seen, coalesce(s.n, 0) = 0 as cold_start from (select 'squad' || i::varchar as key from range(0, 60) t(i)) a left join seen s on s.key = a.key")
def entity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.range(60).select(F.concat(F.lit("squad"), F.col("id").cast("string")).alias("key"))
    return ID.status(keys, contests(spark, sf_dir), "key1").withColumn("last_seen", at("last_seen"))


@query("player_key_precedence", "select doc_id, case when doc_id % 3 = 0 then 'id:' || doc_id::varchar when doc_id % 3 = 1 then 'name:' || lang else 'unknown:' || doc_id::varchar || ':1:2' end as player_key from documents")
def player_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    id_ = F.when(d % 3 == 0, F.concat(d.cast("string"), F.lit(".0")))
    name = F.when(d % 3 == 1, F.col("lang")).when(d % 3 == 2, F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", S.player_key(id_, name, F.concat_ws(":", d.cast("string"), F.lit("1"), F.lit("2"))).alias("player_key"))


@query("both_sides_stack", f"with {VALID_SQL} select match_id, game_id, side, team, opponent, won::bigint as won, margin from sides")
def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.both_sides(contests(spark, sf_dir)).select("match_id", "game_id", "side", "team", "opponent", "won", "margin")


@query("positional_parity", f"with {VALID_SQL}, other as (select row_number() over (order by datetime, match_id desc, game_id) - 1 as row_id, match_id as y from valid) select count(v.match_id) as n_left, count(o.y) as n_right, count(*) filter (v.match_id is distinct from o.y) as n_mismatch from valid v full join other o using (row_id)")
def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.row_ids(contests(spark, sf_dir)).select("row_id", "match_id", "datetime", "game_id")
    other = W.row_ids(rows.withColumn("back", -F.col("match_id")).drop("row_id"), ("datetime", "back", "game_id")).select("row_id", "match_id")
    return J.positional_parity(rows, other, "row_id", "match_id")


ROSTER_KEYS = ["match_id", "game_id"]


@query("roster_unpivot", f"with {ROSTER_SQL} select match_id, game_id, side, slot, player_key as player_id, 'P' || slot::varchar as player from players")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contests(spark, sf_dir)
    wide = rows.select(*ROSTER_KEYS, *[c for s in (1, 2) for k in range(1, 6) for c in (F.lit(f"P{k}").alias(f"team{s}_player{k}"), F.concat(F.lit("id:"), (F.col(f"team{s}_id") * 7 + k + (F.year("datetime") - 1995)).cast("string")).alias(f"team{s}_player{k}_id"))])
    return R.unpivot_roster(wide, ROSTER_KEYS)


@query("side_pivot", f"with {ROSTER_SQL} select match_id, game_id, round(max(case when side = 1 then m end), 6) as team1_adr, round(max(case when side = 2 then m end), 6) as team2_adr from (select match_id, game_id, side, avg(adr) as m from players group by all) group by all")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = players(contests(spark, sf_dir)).groupBy(*ROSTER_KEYS, "side").agg(F.avg("adr").alias("adr"))
    return rounded(R.side_pivot(means, ROSTER_KEYS, ["adr"]), "team1_adr", "team2_adr")


@query("first_per_key", f"with {VALID_SQL} select match_id, game_id, map_name from (select *, row_number() over (partition by match_id order by datetime, game_id) as k from valid) where k = 1")
def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_key(contests(spark, sf_dir), ["match_id"], ["datetime", "game_id"]).select("match_id", "game_id", "map_name")


@query("factorize_codes", f"with {RAW_SQL} select map_name, code, count(*) as n from (select map_name, case when map_name is null then -1 else dense_rank() over (order by map_name nulls last) - 1 end as code from named) group by all")
def factorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.codes(raw_contests(spark, sf_dir), "map_name").groupBy("map_name", "code").agg(F.count(F.lit(1)).alias("n"))


@query("map_position", f"with {VALID_SQL} select match_id, game_id, row_number() over (partition by match_id order by datetime, game_id) as map_position from valid")
def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.map_position(contests(spark, sf_dir)).select("match_id", "game_id", "map_position")


@query("h2h_prior", f"with {VALID_SQL}, per as (select team, opponent, datetime, match_id, sum(won) as w from sides group by all), prior as (select *, coalesce(sum(w) over (partition by team, opponent order by datetime, match_id rows between unbounded preceding and 1 preceding), 0) as h from per) select s.match_id, s.game_id, s.side, p.h::bigint as h2h_wins from sides s join prior p using (team, opponent, datetime, match_id)")
def h2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.h2h_prior(W.both_sides(contests(spark, sf_dir))).select("match_id", "game_id", "side", "h2h_wins")


@query(
    "roll5_prior",
    f"""with {VALID_SQL}, n as (select *, row_number() over (partition by team order by datetime, match_id, game_id, side) as rn from sides),
firsts as (select team, match_id, min(rn) as f from n group by all),
prior as (select f.team, f.match_id, count(p.rn) as c, coalesce(sum(case when p.margin > 0 then 1 else 0 end), 0) as w, coalesce(sum(p.margin), 0) as d
 from firsts f left join n p on p.team = f.team and p.rn between f.f - 5 and f.f - 1 group by all)
select s.match_id, s.game_id, s.side, round(case when p.c > 0 then p.w / p.c::double else 0 end, 6) as roll_win_pct, p.d::double as roll_round_diff from sides s join prior p using (team, match_id)""",
)
def roll5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.form_prior(W.both_sides(contests(spark, sf_dir))).select("match_id", "game_id", "side", "roll_win_pct", "roll_round_diff"), "roll_win_pct")


@query("map_games_prior", f"with {VALID_SQL} select match_id, game_id, side, row_number() over (partition by team, map_name order by datetime, match_id, game_id) - 1 as prior_games from sides")
def map_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.games_prior(W.both_sides(contests(spark, sf_dir)), ["team", "map_name"]).select("match_id", "game_id", "side", "prior_games")


Z = "case when stddev_pop({c}) over w is null or stddev_pop({c}) over w <= 1e-12 then 0 else ({c} - avg({c}) over w) / stddev_pop({c}) over w end"


@query("within_map_zscore", f"with {ROSTER_SQL} select match_id, game_id, side, slot, round({Z.format(c='adr')}, 6) + 0.0 as z_adr from players window w as (partition by match_id, game_id)")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = players(contests(spark, sf_dir)).withColumn("z_adr", F.round(W.safe_z("adr", ROSTER_KEYS), 6))
    return rows.select(*ROSTER_KEYS, "side", "slot", "z_adr")


@query("impact_score", f"with {ROSTER_SQL}, z as (select *, {Z.format(c='adr')} as za, {Z.format(c='kast')} as zk, {Z.format(c='kddiff')} as zd from players window w as (partition by match_id, game_id)) select match_id, game_id, side, slot, round(coalesce(za, 0) + coalesce(zk, 0) + coalesce(zd, 0), 6) as impact from z")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.impact_score(players(contests(spark, sf_dir)), ("adr", "kast", "kddiff"), ROSTER_KEYS).select(*ROSTER_KEYS, "side", "slot", "impact"), "impact")


@query("centered_performance", f"with {ROSTER_SQL}, f as (select *, coalesce(adr, median(adr) over (partition by match_id, game_id, side), 0) as x from players) select match_id, game_id, side, slot, round(x - avg(x) over (partition by match_id, game_id, side), 6) as relative from f")
def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.centred(players(contests(spark, sf_dir)), "adr", [*ROSTER_KEYS, "side"]).select(*ROSTER_KEYS, "side", "slot", "relative"), "relative")


@query("rich_impact", f"with {ROSTER_SQL}, z as (select *, {Z.format(c='adr')} as za, {Z.format(c='kast')} as zk, {Z.format(c='kddiff')} as zd from players window w as (partition by match_id, game_id)), f as (select match_id, max((datetime, game_id)) as last from players group by match_id) select z.match_id, z.game_id, side, slot, round(case when (z.datetime, z.game_id) = f.last and adr is not null and kast is not null and kddiff is not null then za + zk - zd else 0 end, 6) as rich_impact from z join f using (match_id)")
def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.rich_impact(players(contests(spark, sf_dir)), ("adr", "kast"), ("kddiff",), ROSTER_KEYS).select(*ROSTER_KEYS, "side", "slot", "rich_impact"), "rich_impact")


@query("resolution_report", f"with {ALIASES} select t.team, s.slot - 1 as slot, 'Club-' || (t.team * 5 + s.slot)::varchar as player, coalesce(b.key, 'name:club' || (t.team * 5 + s.slot)::varchar) as key, coalesce(n.n, 0) as n_games, coalesce(n.n, 0) = 0 as cold_start from range(0, 8) t(team), range(1, 6) s(slot) left join best b on b.alias = 'club' || (t.team * 5 + s.slot)::varchar left join (select key1 as key, count(*) as n from valid group by key1) n on n.key = b.key")
def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contests(spark, sf_dir)
    index = ID.alias_index(rows, S.ascii_key(F.concat(F.lit("Club "), (F.col("team1_id") % 40).cast("string"))), "key1")
    rosters = spark.createDataFrame([(t, [f"Club-{t * 5 + k}" for k in range(1, 6)]) for t in range(8)], "team long, players array<string>")
    return ID.resolution_report(rosters, index, rows.withColumn("player_key", F.col("key1"))).drop("alias", "last_seen")


@query("entity_gap_days", "select event_id, round(coalesce(greatest(0, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 86400000000.0::double), 0), 6) as gap_days from events")
def gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("datetime", F.col("ts"))
    return rounded(W.gaps(rows, ["user_id"], order=("ts", "event_id")).select("event_id", "gap_days"), "gap_days")


@query("prior_counts", f"with {ROSTER_SQL} select match_id, game_id, side, slot, row_number() over w - 1 as prior, coalesce(sum(case when adr > 50 then 1 else 0 end) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as prior_rich from players window w as (partition by player_key order by datetime, match_id, game_id, side, slot)")
def prior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ("datetime", "match_id", "game_id", "side", "slot")
    rows = W.games_prior(players(contests(spark, sf_dir)), ["player_key"], "prior", order)
    return W.prior_true(rows, ["player_key"], F.coalesce(F.col("adr") > 50, F.lit(False)), "prior_rich", order).select(*ROSTER_KEYS, "side", "slot", "prior", "prior_rich")


@query("lineup_prior_maps", f"with {ROSTER_SQL}, l as (select datetime, match_id, game_id, side, string_agg(player_key, '+' order by player_key) as lineup from players group by all) select match_id, game_id, side, row_number() over (partition by lineup order by datetime, match_id, game_id, side) - 1 as lineup_prior_maps from l")
def lineup_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.lineups(players(contests(spark, sf_dir)))
    return W.games_prior(rows, ["lineup"], "lineup_prior_maps", (*W.ORDER, "side")).select(*ROSTER_KEYS, "side", "lineup_prior_maps")


@query("cold_starts", f"with {ROSTER_SQL}, c as (select *, row_number() over (partition by player_key order by datetime, match_id, game_id, side, slot) = 1 as cold from players) select match_id, game_id, side, count(*) filter (cold) as n_cold from c group by all")
def cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.games_prior(players(contests(spark, sf_dir)), ["player_key"], "prior", ("datetime", "match_id", "game_id", "side", "slot"))
    return rows.groupBy(*ROSTER_KEYS, "side").agg(F.count_if(F.col("prior") == 0).alias("n_cold"))


SPLIT = f"{VALID_SQL}, split as (select *, case when datetime < timestamp '{TRAIN}' then 'train' when datetime < timestamp '{VALIDATION}' then 'validation' else 'test' end as split from valid)"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chronological_split(contests(spark, sf_dir), TRAIN, VALIDATION)


@query("chronological_split", f"with {SPLIT} select match_id, game_id, split from split")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("match_id", "game_id", "split")


@query("split_counts", f"with {SPLIT} select n.position, n.split, count(s.match_id) as n, round(count(s.match_id) / sum(count(s.match_id)) over (), 6) as share from (values (0, 'train'), (1, 'validation'), (2, 'test')) n(position, split) left join split s on s.split = n.split group by all")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.split_counts(_split(spark, sf_dir)), "share")


@query("split_disjointness", f"with {SPLIT} select key1, count(distinct split) as n_splits from split group by key1 having count(distinct split) > 1")
def disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split_overlap(_split(spark, sf_dir), "key1")


@query("split_label_counts", f"with {SPLIT} select split, team1_win, count(*) as n from split group by all")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("split", "team1_win").agg(F.count(F.lit(1)).alias("n"))


@query("symmetrize_v1", f"with {VALID_SQL} select match_id, game_id, team1_id, team2_id, score1_game - score2_game as round_diff, team1_win, false as is_mirrored from valid union all select match_id, game_id, team2_id, team1_id, score2_game - score1_game, 1 - team1_win, true from valid")
def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.differences(contests(spark, sf_dir), {"round_diff": ("score1_game", "score2_game")}).select("match_id", "game_id", "team1_id", "team2_id", "round_diff", "team1_win")
    return R.mirror(rows, [("team1_id", "team2_id")], ["round_diff"], ["team1_win"])


@query("symmetrize_v2", f"with {VALID_SQL} select match_id, game_id, team1_id, team2_id, team1_id - team2_id as id_diff, team1_win, round(team1_id / (team1_id + team2_id + 1.0), 6) as raw_id_prob, false as is_mirrored from valid union all select match_id, game_id, team2_id, team1_id, team2_id - team1_id, 1 - team1_win, round(1 - team1_id / (team1_id + team2_id + 1.0), 6), true from valid")
def symmetrize_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contests(spark, sf_dir).select("match_id", "game_id", "team1_id", "team2_id", (F.col("team1_id") - F.col("team2_id")).alias("id_diff"), "team1_win", (F.col("team1_id") / (F.col("team1_id") + F.col("team2_id") + 1.0)).alias("raw_id_prob"))
    return rounded(R.mirror_by_name(rows), "raw_id_prob")


@query(
    "antisymmetry_check",
    f"""with {VALID_SQL}, two as (
 select match_id, game_id, (score1_game - score2_game)::double as d from valid
 union all select match_id, game_id, case when match_id % 97 = 0 then null when match_id % 89 = 0 then score2_game - score1_game + 1 else score2_game - score1_game end from valid)
select count(*) as n_breaks from (select 1 from two group by match_id, game_id having abs(coalesce(sum(d), 0)) > 1e-9 or count(d) = 1)""",
)
def antisymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored differences, some of them altered or taken away in the copy."""
    off = F.when(F.col("is_mirrored") & (F.col("match_id") % 97 == 0), F.lit(None)).when(F.col("is_mirrored") & (F.col("match_id") % 89 == 0), F.col("round_diff") + 1).otherwise(F.col("round_diff"))
    rows = symmetrize(spark, sf_dir).withColumn("round_diff", off.cast("double"))
    return R.antisymmetry_breaks(rows, ["match_id", "game_id"], ["round_diff"]).agg(F.count(F.lit(1)).alias("n_breaks"))


@query("normalize_names", "select doc_id, regexp_replace(lower(split_part(split_part(doc_id::varchar || ' Player-' || lang || ' (Real Name), XX', ' (', 1), ',', 1)), '[^a-z0-9]+', '', 'g') as player, regexp_replace(regexp_replace(lower('Team ' || source || ' Esports Club-9'), '\\b(team|esports|gaming|club|cs2)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') as team from documents")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit(" Player-"), F.col("lang"), F.lit(" (Real Name), XX"))
    team = F.concat(F.lit("Team "), F.col("source"), F.lit(" Esports Club-9"))
    return read(spark, sf_dir, "documents").select("doc_id", S.fold_text(S.player_text(name)).alias("player"), S.fold_text(S.team_text(team)).alias("team"))


@query("content_hash", "select doc_id, sha256(text) as sha256 from documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import content_hashes

    return content_hashes(read(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@query("link_extraction", """select page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::int as n_links, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages""")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.size(S.hrefs(F.col("html"))).alias("n_links"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("date_parts", "select event_id, extract(year from ts)::int as y, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp from events")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.year("ts").alias("y"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))
