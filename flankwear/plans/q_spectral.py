"""Queries: segmentation, Welch PSD, band / harmonic powers and the spectral
feature table (G01-G05, G07, G08, J07, J08).  The oracle spells the periodic-
Hann DFT out with cos/sin sums."""
from __future__ import annotations

from pyspark.sql import functions as F

from flankwear.operators import profile as pr
from flankwear.operators import report as rp
from flankwear.operators import spectral as sp
from flankwear.operators import wear as wr
from flankwear.plans import bindings as b
from flankwear.plans.catalog import register
from flankwear.plans.sqlgen import moments_sql, present, r, with_ctes

FS, L = b.SPECTRAL_FS, b.SPECTRAL_L
F0 = sp.tooth_pass_hz()
K = ["tool", "passe", "channel"]

SEG_SQL = f"""n AS (SELECT tool, passe, channel, count(*) AS n FROM signals GROUP BY 1, 2, 3),
sg0 AS (SELECT s.tool, s.passe, s.channel, s.i, s.x, least({L}, n.n) AS L FROM signals s JOIN n USING (tool, passe, channel)),
sg1 AS (SELECT *, L - L // 2 AS step, (n_rows - L) // (L - L // 2) + 1 AS nseg
        FROM (SELECT sg0.*, n.n AS n_rows FROM sg0 JOIN n USING (tool, passe, channel))),
seg AS (SELECT tool, passe, channel, CAST(i // step - o AS INTEGER) AS seg, CAST(i - (i // step - o) * step AS INTEGER) AS j,
               x, CAST(L AS INTEGER) AS L
        FROM sg1, (VALUES (0), (1)) t(o)
        WHERE i // step - o >= 0 AND i // step - o < nseg AND i - (i // step - o) * step < L)"""

PSD_SQL = SEG_SQL + f""",
segc AS (SELECT *, x - avg(x) OVER (PARTITION BY tool, passe, channel, seg) AS xc,
                0.5 - 0.5 * cos(2 * pi() * j / L) AS w FROM seg),
wsum AS (SELECT tool, passe, channel, seg, sum(w * w) AS ww FROM segc GROUP BY 1, 2, 3, 4),
bins AS (SELECT range AS k FROM range(0, {L // 2 + 1})),
dft AS (SELECT c.tool, c.passe, c.channel, c.seg, c.L, b.k,
               sum(c.xc * c.w * cos(2 * pi() * c.j * b.k / c.L)) AS re,
               sum(c.xc * c.w * sin(2 * pi() * c.j * b.k / c.L)) AS im
        FROM segc c JOIN bins b ON b.k <= c.L // 2 GROUP BY 1, 2, 3, 4, 5, 6),
pg AS (SELECT d.tool, d.passe, d.channel, d.seg, d.L, d.k,
              (re * re + im * im) / ({FS!r} * ww) * CASE WHEN d.k = 0 THEN 1 WHEN d.L % 2 = 0 AND d.k = d.L // 2 THEN 1 ELSE 2 END AS p
       FROM dft d JOIN wsum USING (tool, passe, channel, seg)),
psd AS (SELECT tool, passe, channel, CAST(k AS INTEGER) AS bin, k * {FS!r} / L AS freq, avg(p) AS psd
        FROM pg GROUP BY tool, passe, channel, k, L)"""


def psd(spark, d):
    return sp.welch(b.spectral_signals(spark, d), FS, L, K)


@register("g01_segments", with_ctes(b.SPECTRAL_SIGNALS_SQL, SEG_SQL)
          + "SELECT tool, passe, channel, seg, count(*) AS n, " + r("sum(x)", "sx") + " FROM seg GROUP BY 1, 2, 3, 4")
def q_g01(spark, d):
    s = sp.segments(b.spectral_signals(spark, d), L, K)
    return present(s.select(*K, "seg", F.col("L").cast("bigint").alias("n"),
                            F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v).alias("sx")))


@register("g02_welch", with_ctes(b.SPECTRAL_SIGNALS_SQL, PSD_SQL)
          + "SELECT tool, passe, channel, bin, " + r("freq", "freq") + ", " + r("psd", "psd") + " FROM psd")
def q_g02(spark, d):
    return present(psd(spark, d))


BANDS_SQL = "bands AS (SELECT * FROM (VALUES " + ", ".join(
    f"('band_{lo}_{hi}', {float(lo)}, {float(hi)})" for lo, hi in sp.BANDS) + ") t(band, lo, hi))"


@register("g03_g04_j07_band_power", with_ctes(b.SPECTRAL_SIGNALS_SQL, PSD_SQL, BANDS_SQL) + """,
bp AS (SELECT p.tool, p.passe, p.channel, b.band, sum(p.psd) AS power FROM psd p JOIN bands b
       ON p.freq >= b.lo AND p.freq < b.hi GROUP BY 1, 2, 3, 4),
tot AS (SELECT tool, passe, channel, sum(psd) AS tot FROM psd GROUP BY 1, 2, 3)
SELECT t.tool, t.passe, t.channel, b.band, """ + r("coalesce(bp.power, 0.0)", "power") + ", "
          + r("coalesce(bp.power, 0.0) / (t.tot + 1e-12)", "power_rel") + """
FROM tot t CROSS JOIN bands b LEFT JOIN bp ON bp.tool = t.tool AND bp.passe = t.passe AND bp.channel = t.channel
  AND bp.band = b.band""")
def q_g03(spark, d):
    return present(sp.band_power(psd(spark, d), K))


HARM_SQL = "harm AS (SELECT * FROM (VALUES " + ", ".join(
    f"('tpf_h{h}', {F0 * h - 30.0!r}, {F0 * h + 30.0!r})" for h in range(1, 6)) + ") t(harmonic, lo, hi))"


@register("g05_j08_tpf_energy", with_ctes(b.SPECTRAL_SIGNALS_SQL, PSD_SQL, HARM_SQL) + """,
he AS (SELECT p.tool, p.passe, p.channel, h.harmonic, sum(p.psd) AS energy FROM psd p JOIN harm h
       ON p.freq BETWEEN h.lo AND h.hi GROUP BY 1, 2, 3, 4),
g AS (SELECT DISTINCT tool, passe, channel FROM psd)
SELECT g.tool, g.passe, g.channel, h.harmonic, """ + r("coalesce(he.energy, 0.0)", "energy") + """
FROM g CROSS JOIN harm h LEFT JOIN he ON he.tool = g.tool AND he.passe = g.passe AND he.channel = g.channel
  AND he.harmonic = h.harmonic""")
def q_g05(spark, d):
    return present(sp.tpf_energy(psd(spark, d), F0, keys=K))


@register("g07_compare_psd", with_ctes(b.SPECTRAL_SIGNALS_SQL, PSD_SQL) + """,
a AS (SELECT channel, bin, freq, psd AS psd_a FROM psd WHERE tool = 'c1' AND passe = 1 AND freq <= 8000.0),
bb AS (SELECT channel, bin, freq, psd AS psd_b FROM psd WHERE tool = 'c1' AND passe = 3 AND freq <= 8000.0)
SELECT coalesce(a.channel, bb.channel) AS channel, coalesce(a.bin, bb.bin) AS bin, """
          + r("coalesce(a.freq, bb.freq)", "freq") + ", " + r("psd_a", "psd_a") + ", " + r("psd_b", "psd_b") + ", "
          + r("psd_b / nullif(psd_a, 0)", "ratio") + """
FROM a FULL OUTER JOIN bb ON a.channel = bb.channel AND a.bin = bb.bin AND a.freq = bb.freq""")
def q_g07(spark, d):
    return present(sp.compare_psd(psd(spark, d), {"tool": "c1", "passe": 1}, {"tool": "c1", "passe": 3}))


def spectral_wear(spark, d):
    w = wr.wear_table(b.raw_wear(spark, d))
    return (w.withColumn("passe", (F.floor((F.col("passe") - 1) / 10) + 1).cast("int"))
            .groupBy("tool", "passe").agg(F.max("vb_mean").alias("vb_mean")))


TSTATS = [s if s != "max" else "peak" for s in ["mean", "std", "rms", "max", "p2p", "skew", "kurt", "crest", "shape",
                                                  "energy", "p25", "p75", "iqr"]]
G08_SQL = with_ctes(
    b.SPECTRAL_SIGNALS_SQL, PSD_SQL, BANDS_SQL, HARM_SQL, b.WEAR_SQL,
    moments_sql("signals", K, name="tfeat"),
    """tl AS (SELECT tool, passe, channel, stat, v FROM (
  SELECT tool, passe, channel, mean, std, rms, max AS peak, p2p, skew, kurt, max / (rms + 1e-12) AS crest, shape,
         energy_mean AS energy, p25, p75, iqr FROM tfeat)
  UNPIVOT INCLUDE NULLS (v FOR stat IN (""" + ", ".join(TSTATS) + """))),
bp AS (SELECT p.tool, p.passe, p.channel, bd.band, sum(p.psd) AS power FROM psd p JOIN bands bd
       ON p.freq >= bd.lo AND p.freq < bd.hi GROUP BY 1, 2, 3, 4),
tot AS (SELECT tool, passe, channel, sum(psd) AS tot FROM psd GROUP BY 1, 2, 3),
bl AS (SELECT t.tool, t.passe, t.channel, bd.band AS stat, coalesce(bp.power, 0.0) AS v
       FROM tot t CROSS JOIN bands bd LEFT JOIN bp ON bp.tool = t.tool AND bp.passe = t.passe
       AND bp.channel = t.channel AND bp.band = bd.band
       UNION ALL
       SELECT t.tool, t.passe, t.channel, bd.band || '_rel', coalesce(bp.power, 0.0) / (t.tot + 1e-12)
       FROM tot t CROSS JOIN bands bd LEFT JOIN bp ON bp.tool = t.tool AND bp.passe = t.passe
       AND bp.channel = t.channel AND bp.band = bd.band),
he AS (SELECT p.tool, p.passe, p.channel, h.harmonic, sum(p.psd) AS energy FROM psd p JOIN harm h
       ON p.freq BETWEEN h.lo AND h.hi GROUP BY 1, 2, 3, 4),
hl AS (SELECT g.tool, g.passe, g.channel, h.harmonic AS stat, coalesce(he.energy, 0.0) AS v
       FROM (SELECT DISTINCT tool, passe, channel FROM psd) g CROSS JOIN harm h LEFT JOIN he ON he.tool = g.tool
       AND he.passe = g.passe AND he.channel = g.channel AND he.harmonic = h.harmonic),
lng AS (SELECT * FROM tl UNION ALL SELECT * FROM bl UNION ALL SELECT * FROM hl),
wide AS (SELECT tool, passe, """ + ", ".join(
        r(f"max(CASE WHEN channel = '{c}' AND stat = '{n}' THEN v END)", f"{c}_{n}")
        for c in b.EVENT_CHANNELS for n in sp.spectral_names()) + """ FROM lng GROUP BY tool, passe),
w3 AS (SELECT tool, CAST(floor((passe - 1) / 10) + 1 AS INTEGER) AS passe, max(vb_mean) AS vb FROM wear GROUP BY 1, 2)""")


@register("g08_spectral_features", G08_SQL + "SELECT wide.*, " + r("w3.vb", "vb") + " FROM wide JOIN w3 USING (tool, passe)")
def q_g08(spark, d):
    out = sp.extract_spectral_features(b.spectral_signals(spark, d), spectral_wear(spark, d), FS, L,
                                       channels=b.EVENT_CHANNELS, f0=F0, long_hook=present)
    return present(out, ["vb"])


@register("a43_spectral_feature_counts", G08_SQL + """SELECT CASE WHEN regexp_matches(name, 'band_|tpf_') THEN 'frequency' ELSE 'time' END AS kind,
  count(DISTINCT name) AS n_features FROM (UNPIVOT (SELECT * EXCLUDE (tool, passe) FROM wide) ON COLUMNS(*) INTO NAME name VALUE v) GROUP BY 1""")
def q_a43_spectral(spark, d):
    """Time and frequency features among the columns of the spectral table that hold values."""
    out = sp.extract_spectral_features(b.spectral_signals(spark, d), spectral_wear(spark, d), FS, L, channels=b.EVENT_CHANNELS, f0=F0)
    held = pr.null_profile(out, [c for c in out.columns if c not in ("tool", "passe", "vb")]).where("n_null < n_rows")
    return rp.feature_counts(held.select(F.col("column").alias("feature")))
