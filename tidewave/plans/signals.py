"""Queries over signals in chunks: grids with halos, rate changes, events, matching, phases, padded wavelets.

A supplier's order lines, in order, are a signal of a recorder; they are cut into chunks
of 100 samples, and the queries put them on grids of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions import filters as K
from tidewave.operators import detection as D
from tidewave.operators import events as E
from tidewave.operators import grid as G
from tidewave.operators import onsets as O
from tidewave.plans.spectral import r6
from tidewave.plans.tables import SAMPLES_SQL, samples, table

RATE, WIDTH, SEGMENT = 100.0, 256, 64
UP, DOWN = 2, 3
TAPS = K.antialias(UP, DOWN, RATE, K.FilterSpec(attenuation_db=60.0, alias_floor_db=-50.0))[0]
FREQS = O.frequencies(5.0, 40.0, 4)
CYCLES = O.cycles(FREQS, 0.1, 2.0)


def signals(spark, sf_dir):
    """series, i, value."""
    rows = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.select(F.col("l_suppkey").alias("series"), (F.row_number().over(order) - 1).cast("long").alias("i"), (F.col("l_extendedprice") / 1000).alias("value"))


def chunks(spark, sf_dir):
    return G.chunked(signals(spark, sf_dir), ["series"], 100)


def grid_halo(spark, sf_dir):
    """Mean and length of every window with its halo."""
    windows = G.grid_windows(chunks(spark, sf_dir), ["series"], WIDTH, 30, 50)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return windows.select("series", F.col("k").cast("long").alias("k"), F.col("at").cast("long").alias("at"), F.size("x").cast("long").alias("n"), (F.round(mean, 6) + 0.0).alias("mean"))


def _states(spark, sf_dir):
    return G.window_states(chunks(spark, sf_dir), ["series"], WIDTH, RATE, SEGMENT, SEGMENT // 2, rails=(10.0, 50.0))


def stream_spectrum(spark, sf_dir):
    """The median over windows of each one's median over segments."""
    return G.merge_spectra(_states(spark, sf_dir), ["series"]).select("series", "k", *r6("db"))


def stream_states(spark, sf_dir):
    out = G.merge_states(_states(spark, sf_dir), ["series"])
    return out.select("series", "n", "n_windows", *r6("rms", "lo", "hi"), "n_lo", "n_hi", "n_rail")


def resample_stream(spark, sf_dir):
    """Two thirds of the rate, across chunk and window borders."""
    out = G.resample(chunks(spark, sf_dir), ["series"], UP, DOWN, TAPS, WIDTH)
    each = out.select("series", "t0_idx", F.posexplode("x").alias("p", "v"))
    return each.select("series", (F.col("t0_idx") + F.col("p")).alias("j"), *r6("v"))


def decimate_stream(spark, sf_dir):
    """A quarter of the rate by the zero-phase recursive filter."""
    out = G.decimate(chunks(spark, sf_dir), ["series"], [4], 4 * WIDTH)
    each = out.select("series", "t0_idx", F.posexplode("x").alias("p", "v"))
    return each.select("series", (F.col("t0_idx") + F.col("p")).alias("j"), *r6("v"))


def hysteresis_bursts(spark, sf_dir):
    """Stretches from a value of 70 on to the last before one below 20, with their edges."""
    out = E.bursts(signals(spark, sf_dir), ["series"], "i", "value", F.lit(70.0), F.lit(20.0))
    return out.select("series", F.col("burst").cast("long").alias("burst"), "first", "last", "n", *r6("peak"))


def artifact_onsets(spark, sf_dir):
    """Where the magnitude crosses 1.2 robust deviations, at least 50 ms apart."""
    return E.artifact_onsets(signals(spark, sf_dir), ["series"], RATE, 1.2, 50.0).select("series", F.col("onset").cast("long").alias("onset"))


def stim_responses(spark, sf_dir):
    """After every artifact, 40 ms blanked, 320 ms kept: sum and range."""
    found = E.artifact_onsets(signals(spark, sf_dir), ["series"], RATE, 1.2, 500.0)
    events = found.select("series", F.concat_ws("-", "series", F.col("onset").cast("long")).alias("id"), (F.col("onset") / RATE).alias("onset"))
    out = E.responses(chunks(spark, sf_dir), ["series"], events, RATE, 40.0, 320.0)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return out.select("series", (F.round("onset", 6) + 0.0).alias("onset"), (F.round(total, 6) + 0.0).alias("total"), (F.round(F.array_max("x") - F.array_min("x"), 6) + 0.0).alias("spread"))


def pulse_trains(spark, sf_dir):
    """A session's clicks as pulses; more than two days apart they are another train."""
    clicks = samples(spark, sf_dir).where("channel = 'click'").select("session", "onset").distinct()
    out = E.pulse_trains(clicks, ["session"], 2 * 86400.0)
    return out.select("session", F.col("train").cast("long").alias("train"), *r6("t_on", "t_off"), "n", (F.round(F.col("rate") * 86400, 6) + 0.0).alias("per_day"))


_TOLERANCE = 86400.0


def _two_streams(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.where("channel = 'click'"), s.where("channel = 'view'")


def match_events(spark, sf_dir):
    """A session's clicks and views in pairs, at most a day apart."""
    out = E.match_one_to_one(*_two_streams(spark, sf_dir), ["session"], _TOLERANCE)
    return out.select("session", *r6("t_a", "t_b"))


def match_scores(spark, sf_dir):
    out = E.match_scores(E.match_one_to_one(*_two_streams(spark, sf_dir), ["session"], _TOLERANCE), ["session"])
    return out.select("session", "hits", "missed", "false_alarms", *r6("precision", "recall"), (F.round("jitter", 3) + 0.0).alias("jitter"))


def match_counts(spark, sf_dir):
    """Clicks with any view within a day, those without, and views without a click."""
    return E.match_counts(*_two_streams(spark, sf_dir), ["session"], _TOLERANCE).select("session", "hits", "missed", "false_alarms")


def _phases(spark, sf_dir):
    """Clicks' values as a phase of the session at their onsets; of equal onsets the first counts."""
    first = samples(spark, sf_dir).where("channel = 'click'").groupBy("session", "onset").agg(F.min_by("value", "i").alias("v"))
    return first.select("session", F.col("onset").alias("t"), E.wrapped(F.col("v")).alias("phase"))


def phases_at_events(spark, sf_dir):
    """The phase at a session's purchases, between the clicks before and after."""
    buys = samples(spark, sf_dir).where("channel = 'purchase'").select("session", "onset").distinct()
    return E.phases_at(_phases(spark, sf_dir), buys, ["session"]).select("session", *r6("onset"), (F.round("at", 6) + 0.0).alias("phase"))


def event_locking(spark, sf_dir):
    buys = samples(spark, sf_dir).where("channel = 'purchase'").select("session", "onset").distinct()
    out = E.locking(E.phases_at(_phases(spark, sf_dir), buys, ["session"]), ["session"])
    return out.select("session", "n", *r6("plv", "ppc"))


def onset_power(spark, sf_dir):
    """Wavelet power around sample 200 of every signal, padded by the widest wavelet's reach, against -0.4 to -0.2 s."""
    onsets = signals(spark, sf_dir).groupBy("series").agg(F.lit(2.0).alias("onset")).withColumn("id", F.col("series"))
    maps = O.onset_power(chunks(spark, sf_dir), ["series"], onsets, RATE, FREQS, CYCLES, -0.4, 0.4, 4)
    out = O.against_baseline(maps, ["series"], -0.4, -0.2)
    return out.select("series", *r6("freq", "t", "value"))


DETECTORS = {
    "min_channels_for_outlier_stats": 4,
    "detectors": {
        "flat_channel": {"severity": "high", "std_fraction_of_median": 0.97, "proposed_action": "exclude_channel"},
        "variance_outlier": {"severity": "med", "robust_z_max": 2.0, "proposed_action": "exclude_channel"},
        "kurtosis_outlier": {"severity": "med", "block_s": 2.0, "max_excess_kurtosis": -0.75, "proposed_action": "exclude_channel"},
        "clipping": {"severity": "high", "fraction_at_rail_max": 0.0016, "proposed_action": "exclude_channel"},
    },
}


def detect_all(spark, sf_dir):
    """Four detectors over one scan: a nation's suppliers are the channels of a session."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("series"), F.col("s_nationkey").alias("session"))
    rows = chunks(spark, sf_dir).join(nations, "series").withColumn("channel", F.col("series").cast("string"))
    channels = nations.select("session", F.col("series").cast("string").alias("channel"), F.lit("all").alias("region"), F.lit(None).cast("string").alias("kind"))
    flags = D.detect_all(rows, ["session"], channels, RATE, DETECTORS)
    return flags.select(F.col("session").cast("long").alias("session"), "flag_type", "target", "detector", "severity", "proposed_action", "flag_id")


QUERIES = {
    f.__name__: f
    for f in (
        grid_halo, stream_spectrum, stream_states, resample_stream, decimate_stream, hysteresis_bursts, artifact_onsets, stim_responses, pulse_trains, match_events,
        match_scores, match_counts, phases_at_events, event_locking, onset_power, detect_all,
    )
}

_SIGNALS = """signals as (
  select l_suppkey as series, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as i, l_extendedprice / 1000 as value from lineitem
)"""
_R = "round({0}, 6) + 0.0 as {1}"
_ON = """level as (
  select series, m + 1.2 * 1.4826 * median(abs(abs(value) - m)) as level from signals join (select series, median(abs(value)) as m from signals group by 1) using (series) group by series, m
), crossed as (
  select series, i, size > level as above, coalesce(lag(size > level) over (partition by series order by i), false) as before
  from (select series, i, abs(value) as size from signals) join level using (series)
), starts as (
  select series, i, row_number() over (partition by series order by i) as r from crossed where above and not before
), kept as (
  select series, r, i, i as last, true as far from starts where r = 1
  union all select s.series, s.r, s.i, case when s.i - k.last >= {gap} then s.i else k.last end, s.i - k.last >= {gap} from kept k join starts s on s.series = k.series and s.r = k.r + 1
)"""
_MATCH = f"""with recursive {SAMPLES_SQL}, merged as (
  select session, onset, side, row_number() over (partition by session order by onset, side) as r from (
    select session, onset, case channel when 'click' then 0 else 1 end as side from samples where channel in ('click', 'view'))
), run as (
  select session, 0::bigint as r, 0 as side, []::double[] as waiting, null::double as t_a, null::double as t_b from (select distinct session from merged)
  union all
  select m.session, m.r, case when hit then run.side else m.side end,
    case when hit then alive[2:] when run.side <> m.side then [m.onset] else alive || [m.onset] end,
    case when hit then case when m.side = 0 then m.onset else alive[1] end end, case when hit then case when m.side = 1 then m.onset else alive[1] end end
  from (select run.*, m.onset, m.side as m_side, list_filter(waiting, lambda p: m.onset - p <= {_TOLERANCE}) as alive,
      run.side <> m.side and len(list_filter(waiting, lambda p: m.onset - p <= {_TOLERANCE})) > 0 as hit from run join merged m on m.session = run.session and m.r = run.r + 1) run
    join merged m on m.session = run.session and m.r = run.r + 1
), hits as (
  select session, t_a, t_b from run where t_a is not null
), ordered as (
  select session, onset, side, row_number() over (partition by session, side, onset order by onset) as n from merged
), pairs as (
  select session, t_a, t_b from hits
  union all
  select o.session, case when side = 0 then o.onset end, case when side = 1 then o.onset end from ordered o
  where n > (select count(*) from hits h where h.session = o.session and case when o.side = 0 then h.t_a else h.t_b end = o.onset)
)"""
_AT = f"""with {SAMPLES_SQL}, phases as (
  select session, onset as t, v - 2 * pi() * floor((v + pi()) / (2 * pi())) as phase from (select session, onset, arg_min(value, i) as v from samples where channel = 'click' group by 1, 2)
), buys as (
  select distinct session, onset from samples where channel = 'purchase'
), sides as (
  select b.session, b.onset, max(p.t) filter (where p.t <= b.onset) as t0, min(p.t) filter (where p.t >= b.onset) as t1 from buys b left join phases p on p.session = b.session group by 1, 2
), between_ as (
  select s.session, s.onset, p.phase as a, q.phase - p.phase as d, coalesce((s.onset - t0) / nullif(t1 - t0, 0), 0) as share
  from sides s left join phases p on p.session = s.session and p.t = t0 left join phases q on q.session = s.session and q.t = t1
), turned as (
  select session, onset, a + (d - 2 * pi() * floor((d + pi()) / (2 * pi()))) * share as u from between_
), at_ as (
  select session, onset, u - 2 * pi() * floor((u + pi()) / (2 * pi())) as ang from turned
)"""
_BIAS = "(1 + coalesce(list_sum(list_transform(range(1, (n_seg - 1) // 2 + 1), lambda m: 1.0 / (2 * m + 1) - 1.0 / (2 * m))), 0))"


def _wave_rows() -> str:
    """freq, k, re, im of every wavelet's samples."""
    rows = []
    for f, c in zip(FREQS, CYCLES, strict=True):
        w = O.wavelet(f, c, RATE)
        half = len(w) // 2
        rows += [f"({float(f)!r}, {k - half}, {v.real!r}, {v.imag!r})".replace("np.float64(", "").replace("))", ")") for k, v in enumerate(w.tolist())]
    return ", ".join(rows)


_PAD = O.reach(FREQS, CYCLES, RATE)
ORACLES = {
    "grid_halo": f"""with {_SIGNALS}, sizes as (select series, count(*) as n from signals group by 1),
      w as (select series, n, unnest(range(0, (n - 1) // {WIDTH} + 1)) as k from sizes)
      select w.series, k::bigint as k, min(i)::bigint as at, count(*) as n, {_R.format('avg(value)', 'mean')} from w join signals s on s.series = w.series
        and i >= k * {WIDTH} - 30 and i < (k + 1) * {WIDTH} + 50 group by 1, 2""",
    "stream_spectrum": f"""with {_SIGNALS}, w as (select series, i // {WIDTH} as k, i % {WIDTH} as j, value, count(*) over (partition by series, i // {WIDTH}) as n from signals),
      p as (select *, unnest(range(0, (n - {SEGMENT}) // {SEGMENT // 2} + 1)) as p from w where n >= {SEGMENT}),
      seg as (select series, k, p, j - p * {SEGMENT // 2} as t, value from p where j >= p * {SEGMENT // 2} and j < p * {SEGMENT // 2} + {SEGMENT}),
      own as (select series, k, p, t, (value - avg(value) over (partition by series, k, p)) * (0.5 - 0.5 * cos(2 * pi() * t / {SEGMENT})) as v from seg),
      f as (select series, k, p, b, sum(v * cos(2 * pi() * b * t / {SEGMENT})) as re, sum(v * sin(2 * pi() * b * t / {SEGMENT})) as im from own, range(0, {SEGMENT // 2 + 1}) r(b) group by 1, 2, 3, 4),
      z as (select sum((0.5 - 0.5 * cos(2 * pi() * t / {SEGMENT})) ** 2) as z from range(0, {SEGMENT}) r(t)),
      d as (select series, k, b, count(*) as n_seg, median((re * re + im * im) / ({RATE} * z) * case when b in (0, {SEGMENT // 2}) then 1 else 2 end) as m from f, z group by 1, 2, 3)
      select series, b::bigint as k, {_R.format('10 * log10(greatest(median(m / ' + _BIAS + '), 1.1754943508222875e-38))', 'db')} from d group by 1, 2""",
    "stream_states": f"""with {_SIGNALS}, e as (select *, min(value) over (partition by series) as lo, max(value) over (partition by series) as hi from signals)
      select series, count(*) as n, (count(*) // {WIDTH} + case when count(*) % {WIDTH} >= {SEGMENT} then 1 else 0 end)::bigint as n_windows, {_R.format('sqrt(sum(value * value) / count(*))', 'rms')},
        {_R.format('any_value(lo)', 'lo')}, {_R.format('any_value(hi)', 'hi')}, count(*) filter (where value = lo) as n_lo, count(*) filter (where value = hi) as n_hi,
        count(*) filter (where value in (10.0, 50.0)) as n_rail from e group by 1""",
    "resample_stream": f"""with {_SIGNALS}, ends as (select series, count(*) as n, arg_min(value, i) as a, arg_max(value, i) as b from signals group by 1),
      h as (select unnest({TAPS.tolist()!r}) as h, generate_subscripts({TAPS.tolist()!r}, 1) - 1 as m),
      j as (select *, unnest(range(0, (n * {UP} + {DOWN - 1}) // {DOWN})) as j from ends)
      select j.series, j.j::bigint as j, {_R.format(f'any_value(a + (b - a) * j * {DOWN} / {UP} / greatest(n - 1, 1)) + coalesce(sum({UP} * h * (value - (a + (b - a) * i / greatest(n - 1, 1)))), 0)', 'v')}
      from j cross join h left join signals s on s.series = j.series and (j * {DOWN} + {(len(TAPS) - 1) // 2} - m) % {UP} = 0 and s.i = (j * {DOWN} + {(len(TAPS) - 1) // 2} - m) // {UP} group by 1, 2""",
    "hysteresis_bursts": f"""with {_SIGNALS}, t as (select *, case when value >= 70 then true when value < 20 then false end as turn from signals),
      s as (select *, coalesce(last_value(turn ignore nulls) over (partition by series order by i rows between unbounded preceding and current row), false) as state from t),
      b as (select *, state and not coalesce(lag(state) over (partition by series order by i), false) as new from s),
      n as (select *, sum(new::int) over (partition by series order by i rows between unbounded preceding and current row)::bigint as burst from b)
      select series, burst, min(i) as first, max(i) as last, count(*) as n, {_R.format('max(value)', 'peak')} from n where state group by 1, 2""",
    "artifact_onsets": f"with recursive {_SIGNALS}, {_ON.format(gap=5)} select series, i as onset from kept where far",
    "stim_responses": f"""with recursive {_SIGNALS}, {_ON.format(gap=50)} select k.series, {_R.format('k.i / 100.0', 'onset')}, {_R.format('sum(value)', 'total')}, {_R.format('max(value) - min(value)', 'spread')}
      from kept k join signals s on s.series = k.series and s.i >= k.i + 4 and s.i < k.i + 36 where far group by k.series, k.i having count(*) = 32""",
    "pulse_trains": f"""with {SAMPLES_SQL}, c as (select distinct session, onset from samples where channel = 'click'),
      g as (select *, coalesce(onset - lag(onset) over (partition by session order by onset), 1e18) > 172800 as new from c),
      t as (select *, sum(new::int) over (partition by session order by onset rows between unbounded preceding and current row)::bigint as train from g)
      select session, train, {_R.format('min(onset)', 't_on')}, {_R.format('max(onset)', 't_off')}, count(*) as n, {_R.format('case when count(*) > 1 then (count(*) - 1) / nullif(max(onset) - min(onset), 0) end * 86400', 'per_day')} from t group by 1, 2""",
    "match_events": f"{_MATCH} select session, {_R.format('t_a', 't_a')}, {_R.format('t_b', 't_b')} from pairs",
    "match_scores": f"""{_MATCH} select session, count(*) filter (where t_a is not null and t_b is not null) as hits, count(*) filter (where t_b is null) as missed, count(*) filter (where t_a is null) as false_alarms,
      {_R.format('hits / nullif(hits + false_alarms, 0)', 'precision')}, {_R.format('hits / nullif(hits + missed, 0)', 'recall')}, round(stddev_pop(t_b - t_a), 3) + 0.0 as jitter from pairs group by 1""",
    "match_counts": f"""with {SAMPLES_SQL}, a as (select session, onset from samples where channel = 'click'), b as (select session, onset from samples where channel = 'view'),
      x as (select session, exists (select 1 from b where b.session = a.session and abs(b.onset - a.onset) <= {_TOLERANCE}) as hit, 0 as side from a
        union all select session, exists (select 1 from a where a.session = b.session and abs(b.onset - a.onset) <= {_TOLERANCE}), 1 from b)
      select session, count(*) filter (where side = 0 and hit) as hits, count(*) filter (where side = 0 and not hit) as missed, count(*) filter (where side = 1 and not hit) as false_alarms from x group by 1""",
    "phases_at_events": f"{_AT} select session, {_R.format('onset', 'onset')}, {_R.format('ang', 'phase')} from at_",
    "event_locking": f"""{_AT} select session, count(ang) as n, {_R.format('sqrt(sum(cos(ang)) ** 2 + sum(sin(ang)) ** 2) / count(ang)', 'plv')},
      {_R.format('(sum(cos(ang)) ** 2 + sum(sin(ang)) ** 2 - count(ang)) / nullif(count(ang) * (count(ang) - 1), 0)', 'ppc')} from at_ where ang is not null group by 1""",
    "onset_power": f"""with {_SIGNALS}, waves(freq, k, re, im) as (values {_wave_rows()}),
      long_ as (select series from signals group by 1 having count(*) > 200 + 40 + {_PAD}),
      p as (select s.series, freq, t, sum(value * re) ** 2 + sum(value * im) ** 2 as power from range(-40, 41, 4) r(t), waves, signals s join long_ using (series) where s.i = 200 + t - k group by 1, 2, 3),
      b as (select series, freq, avg(power) as m from p where t / 100.0 between -0.4 and -0.2 group by 1, 2)
      select series, {_R.format('freq', 'freq')}, {_R.format('t / 100.0', 't')}, {_R.format('10 * log10(power / m)', 'value')} from p join b using (series, freq)""",
    "detect_all": f"""with {_SIGNALS}, c as (select s_nationkey as session, series, value, i, series::varchar as channel from signals join supplier on s_suppkey = series),
      per as (select session, channel, stddev_pop(value) as sd, max(abs(value)) as rail, count(*) as n from c group by 1, 2),
      mid as (select session, median(sd) as m, count(*) as members, median(log10(sd + 1e-12)) as lm from per group by 1),
      mad as (select session, median(abs(log10(sd + 1e-12) - lm)) as d from per join mid using (session) group by 1),
      w as (select session, channel, i // 100 as k, count(*) as n, avg(value) as mean from c group by 1, 2, 3),
      nb as (select session, channel, count(*) filter (where n = 100) as nb from w group by 1, 2),
      z as (select *, case when nb // 2 < 5 then greatest(nb // 5, 1) else 2 end as size from nb),
      b as (select c.session, c.channel, case when nb // size < 3 then 0 when i // 100 < nb // size * size then (i // 100) // size end as b, value from c join z using (session, channel)),
      mo as (select session, channel, b, count(*)::double as n, avg(value) as mean from b where b is not null group by 1, 2, 3),
      ku as (select b.session, b.channel, b.b, any_value(n) as n, sum((value - mean) ** 2) as m2, sum((value - mean) ** 4) as m4 from b join mo using (session, channel, b) group by 1, 2, 3),
      typical as (select session, channel, median(case when n > 3 then (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6) end) as kurtosis from ku group by 1, 2),
      flags as (
        select session, 'flat_channel' as flag_type, channel as target, '' as detector, 'high' as severity, 'exclude_channel' as proposed_action from per join mid using (session) where m > 0 and sd < m * 0.97
        union all select session, 'variance_outlier', channel, 'variance_outlier', 'med', 'exclude_channel' from per join mid using (session) join mad using (session)
          where members >= 4 and abs(coalesce((log10(sd + 1e-12) - lm) / nullif(1.4826 * d, 0), 0)) > 2
        union all select session, 'insufficient_channels', 'group:all', 'variance_outlier', 'low', '' from mid where members < 4
        union all select session, 'kurtosis_outlier', channel, 'kurtosis_outlier', 'med', 'exclude_channel' from typical where kurtosis > -0.75
        union all select session, 'clipping', channel, 'clipping', 'high', 'exclude_channel' from (
          select session, channel, n, count(*) filter (where abs(abs(value) - rail) <= 1e-8 + 1e-6 * rail) as at_rail from c join per using (session, channel) group by 1, 2, 3) where at_rail / n > 0.0016
      )
      select session::bigint as session, flag_type, target, detector, severity, proposed_action, substr(sha256('channel|' || target || '|' || flag_type || '|' || detector), 1, 16) as flag_id from flags""",
}
