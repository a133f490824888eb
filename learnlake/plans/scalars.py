"""Queries that apply the scalar functions to whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnlake.functions import dates, sessions, similarity, text, times
from learnlake.plans.registry import query
from learnlake.sources import roles
from learnlake.sources.roles import with_roles


def _part(spark, sf_dir):
    return roles.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key, trim(regexp_replace('  ' || p_name || '  x ', '\s+', ' ', 'g')) AS collapsed, list_aggregate(list_sort(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), '')), 'string_agg', '') AS anagram FROM part")
def text_keys(spark, sf_dir):
    """the keys under which spellings meet."""
    n = F.col("p_name")
    spaced = F.concat(F.lit("  "), n, F.lit("  x "))
    return _part(spark, sf_dir).select("p_partkey", text.normalize_key(n).alias("key"), text.collapse_ws(spaced).alias("collapsed"), text.anagram_key(n).alias("anagram"))


@query(r"SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '--' ELSE ' ' || p_brand || '/' || p_type || '!' END AS x FROM part))")
def slugs(spark, sf_dir):
    """identifiers made of names."""
    x = F.when(F.col("p_partkey") % 10 == 0, "--").otherwise(F.concat(F.lit(" "), "p_brand", F.lit("/"), "p_type", F.lit("!")))
    return _part(spark, sf_dir).select("p_partkey", text.slugify(x).alias("slug"))


@query("""SELECT o_orderkey, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND y BETWEEN 1900 AND 2100 THEN TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) END AS strict,
    CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 AND y BETWEEN 1900 AND 2100 THEN make_date(y, m, least(d, CAST(day(last_day(make_date(y, m, CAST(1 AS BIGINT)))) AS BIGINT))) END AS clamped FROM (
    SELECT o_orderkey, o_orderkey % 33 AS d, CASE WHEN o_orderkey % 14 = 0 THEN 6 ELSE o_orderkey % 14 END AS m, 2000 + o_orderkey % 27 AS y FROM orders)""")  # fmt: skip
def date_parse(spark, sf_dir):
    """F8: day, month, year in many spellings; a day beyond the month is refused or clamped."""
    k = F.col("o_orderkey")
    raw = F.concat_ws("/", (k % 33).cast("string"), F.when(k % 14 == 0, F.lit(6)).otherwise(k % 14).cast("string"), F.lpad((k % 27).cast("string"), 2, "0"))
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", dates.parse_date(F.col("raw")).alias("strict"), dates.parse_date(F.col("raw"), clamp_day=True).alias("clamped"))


@query("SELECT o_orderkey, CASE WHEN h BETWEEN 0 AND 23 AND m BETWEEN 0 AND 59 THEN printf('%02d:%02d', h, m) END AS at, CASE WHEN h BETWEEN 0 AND 23 AND m BETWEEN 0 AND 59 THEN CAST(h * 60 + m AS INTEGER) END AS minutes FROM (SELECT o_orderkey, o_orderkey % 26 AS h, o_orderkey % 63 AS m FROM orders)")
def time_parse(spark, sf_dir):
    """times with odd separators; what is out of range is null."""
    k = F.col("o_orderkey")
    sep = F.element_at(F.array(*map(F.lit, (":", ";", ".", '"'))), (k % 4 + 1).cast("int"))
    raw = F.concat((k % 26).cast("string"), sep, F.lpad((k % 63).cast("string"), 2, "0"))
    at = times.parse_time(raw)
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"), times.hhmm_minutes(at).alias("minutes"))


@query(with_roles("SELECT student_id, day, pair, CASE WHEN a < 480 THEN a + 720 ELSE a END AS start, CASE WHEN b <= a AND b < 720 AND b + 720 > a AND b + 720 - a <= 600 THEN b + 720 ELSE b END AS finish FROM (SELECT student_id, day, pair, m_in % 720 AS a, m_out % 720 AS b FROM pairs WHERE m_out IS NOT NULL)", "pairs"))
def pm_slip_fix(spark, sf_dir):
    """afternoons written as mornings."""
    from learnlake.operators import punches

    p = punches.pairs(roles.punches(spark, sf_dir)).filter("m_out is not null").select("student_id", "day", "pair", (F.col("m_in") % 720).alias("a"), (F.col("m_out") % 720).alias("b"))
    return p.select("student_id", "day", "pair", times.repair_morning_slip(F.col("a")).alias("start"), times.repair_leaving_slip(F.col("a"), F.col("b")).alias("finish"))


@query(with_roles("SELECT student_id, day, pair, CASE WHEN b < a AND a >= 1080 THEN b ELSE a END AS start, CASE WHEN b < a AND a >= 1080 THEN a ELSE b END AS finish FROM (SELECT student_id, day, pair, CASE WHEN pair % 2 = 0 THEN m_out ELSE m_in END AS a, CASE WHEN pair % 2 = 0 THEN m_in ELSE m_out END AS b FROM pairs WHERE m_out IS NOT NULL)", "pairs"))
def swapped_pairs(spark, sf_dir):
    """arrival and departure in the wrong columns."""
    from learnlake.operators import punches

    p = punches.pairs(roles.punches(spark, sf_dir)).filter("m_out is not null")
    even = F.col("pair") % 2 == 0
    fixed = times.unswap(F.when(even, F.col("m_out")).otherwise(F.col("m_in")), F.when(even, F.col("m_in")).otherwise(F.col("m_out")))
    return p.select("student_id", "day", "pair", fixed["start"].alias("start"), fixed["end"].alias("finish"))


_SESSION = """SELECT student_id, day, pair, CASE WHEN m_in >= 780 THEN 'Afternoon' WHEN m_out IS NULL OR m_out <= {edge} THEN 'Morning' ELSE 'Full Day' END AS session, {minutes} AS minutes FROM pairs"""


@query(with_roles(_SESSION.format(edge=840, minutes="CAST(CASE WHEN m_in >= 780 OR m_out <= 780 THEN m_out - m_in WHEN m_out <= 840 THEN 780 - m_in ELSE 780 - m_in + m_out - 840 END AS INTEGER)"), "pairs"))
def session_live(spark, sf_dir):
    """the rule for live punches."""
    from learnlake.operators import punches

    a, b = F.col("m_in"), F.col("m_out")
    return punches.pairs(roles.punches(spark, sf_dir)).select("student_id", "day", "pair", sessions.live_session(a, b).alias("session"), sessions.live_duration(a, b).alias("minutes"))


@query(with_roles(_SESSION.format(edge=780, minutes="CAST(CASE WHEN m_out IS NOT NULL THEN m_out - m_in - greatest(0, least(m_out, 840) - greatest(m_in, 780)) END AS INTEGER)"), "pairs"))
def session_batch(spark, sf_dir):
    """the rule for loaded sheets."""
    from learnlake.operators import punches

    a, b = F.col("m_in"), F.col("m_out")
    p = punches.pairs(roles.punches(spark, sf_dir))
    return p.select("student_id", "day", "pair", sessions.batch_session(a, b).alias("session"), F.when(b.isNotNull(), sessions.batch_duration(a, b)).alias("minutes"))


@query(with_roles("SELECT CASE WHEN m_in >= 780 AND m_out IS NOT NULL THEN 'afternoon' WHEN m_out IS NULL THEN 'open' WHEN m_out <= 780 THEN 'morning' ELSE 'full_day' END AS session, count(*) AS n FROM pairs GROUP BY 1", "pairs"))
def session_cleaner(spark, sf_dir):
    """the rule of the cleaning step."""
    from learnlake.operators import punches

    return punches.pairs(roles.punches(spark, sf_dir)).groupBy(sessions.cleaner_session(F.col("m_in"), F.col("m_out")).alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(d + INTERVAL (12 * (n + 1)) MONTH AS DATE) AS valid_until, CAST(greatest(1, ceil(CAST(DATE '2001-08-01' - d AS DOUBLE) / 365.25)) AS INTEGER) AS gap FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 5 AS INTEGER) AS n FROM orders)")
def valid_until(spark, sf_dir):
    """Membership ends; leap days end on Feb 28."""
    d = F.to_date("o_orderdate")
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", dates.add_years(d, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("valid_until"), dates.years_gap(F.lit(roles.TODAY_ORDERS), d).alias("gap"))


@query("SELECT o_orderkey, CAST(greatest(CASE WHEN k > 0 AND CAST(d + INTERVAL (12 * k) MONTH AS DATE) >= DATE '2001-08-01' THEN k - 1 ELSE k END, 0) AS INTEGER) AS n FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(2001 - year(o_orderdate) AS INTEGER) AS k FROM orders)")
def renewals_needed(spark, sf_dir):
    """Renewals that reach today."""
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", dates.renewals_needed(F.to_date("o_orderdate"), F.lit(roles.TODAY_ORDERS)).alias("n"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, (dayofweek(o_orderdate) = 0 OR (dayofweek(o_orderdate) = 6 AND ceil(day(o_orderdate) / 7.0) IN (2, 4, 5))) AS closed, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS sunday, CAST(DATE '2001-08-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS ago FROM orders")
def weekday_occurrence(spark, sf_dir):
    """closures, starts of weeks, distance to today."""
    d = roles.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    c = F.col("date")
    return d.select("date", dates.is_weekly_closure(c).alias("closed"), dates.monday(c).alias("monday"), dates.sunday(c).alias("sunday"), (-dates.days_until(c, F.lit(roles.TODAY_ORDERS))).alias("ago"))


_BIGRAMS = "list_distinct(list_transform(generate_series(1, length({0}) - 1), lambda i: substring({0}, CAST(i AS BIGINT), 2)))"


@query(f"SELECT a, b, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS dice FROM (SELECT a.p_type AS a, b.p_type AS b, {_BIGRAMS.format('a.p_type')} AS x, {_BIGRAMS.format('b.p_type')} AS y FROM (SELECT DISTINCT p_type FROM part) a JOIN (SELECT DISTINCT p_type FROM part) b ON substring(a.p_type, 1, 1) = substring(b.p_type, 1, 1) AND a.p_type <= b.p_type)")
def bigram_dice(spark, sf_dir):
    """similarity of distinct types that begin alike."""
    t = _part(spark, sf_dir).select(F.col("p_type").alias("t")).distinct().withColumn("first", F.substring("t", 1, 1))
    pairs = t.withColumnRenamed("t", "a").join(t.withColumnRenamed("t", "b"), "first").filter("a <= b")
    return pairs.select("a", "b", F.round(text.bigram_dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query(r"SELECT event_id, CAST(props::json->>'k' AS INTEGER) AS k FROM events")
def json_prop(spark, sf_dir):
    """JSON text to a typed field, with a schema given."""
    return roles.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT o_orderkey, CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm' ELSE CAST(m // 60 AS VARCHAR) || 'h ' || CAST(m % 60 AS VARCHAR) || 'm' END AS label, round(m / 239.0 * 100, 2) AS percent FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) % 240 AS INTEGER) AS m FROM orders)")
def duration_labels(spark, sf_dir):
    """Durations for people, and shares."""
    m = F.col("minutes")
    return roles.usage(spark, sf_dir).select(F.col("usage_id").alias("o_orderkey"), times.duration_label(m).alias("label"), times.percentage(m, F.lit(239)).alias("percent"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'P-' || CAST(s_suppkey AS VARCHAR) ELSE 'B' || CAST(s_suppkey AS VARCHAR) END AS canonical, CAST(s_suppkey AS BIGINT) AS digits, CASE WHEN s_suppkey % 3 = 0 THEN 'P' ELSE 'B' END AS prefix, ltrim(CAST(s_suppkey AS VARCHAR), '0') AS rest FROM supplier")
def catalogue_ids(spark, sf_dir):
    """identifiers of periodicals and books, their letters and numbers."""
    k = F.col("s_suppkey").cast("string")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("p . "), k)).otherwise(F.concat(F.lit("B"), k))
    s = roles.table(spark, sf_dir, "supplier").select("s_suppkey", text.periodical_id(raw).alias("canonical"))
    c = F.col("canonical")
    return s.select("s_suppkey", "canonical", text.member_digits(c).alias("digits"), text.id_prefix(c).alias("prefix"), text.id_rest(c).alias("rest"))


@query("SELECT p_partkey, p_size AS heads, p_name AS title, p_type AS core, regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') AS identity FROM part")
def exam_titles(spark, sf_dir):
    """head counts and exam suffixes come off."""
    raw = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(" )"))
    topic = F.concat("p_type", F.lit(" Grand Test (morning)"))
    return _part(spark, sf_dir).select("p_partkey", text.head_count(raw).alias("heads"), text.without_head_count(raw).alias("title"), text.strip_exam_suffix(topic).alias("core"), text.exam_identity_key(topic).alias("identity"))


@query("SELECT a, b, CAST(damerau_levenshtein(a, b) AS INTEGER) AS distance FROM (SELECT DISTINCT p_type AS a, replace(p_type, 'A', 'E') AS b FROM part)")
def edit_distance(spark, sf_dir):
    """edits with exchanges of neighbours, over distinct pairs."""
    t = _part(spark, sf_dir).select(F.col("p_type").alias("a"), F.regexp_replace("p_type", "A", "E").alias("b")).distinct()
    return t.withColumn("distance", similarity.osa_distance("a", "b"))


def _sound_sql(word: str) -> str:
    """The rules of similarity.SOUNDS for an engine without look-around: contexts are captured and put back, twice where they may overlap."""
    steps = [
        *[(f"{c}{c}+", c) for c in "ABDEFGHIJKLMNOPQRSTUVWXYZ"], ("^[KGP](N)|^A(E)|^W(R)", r"\1\2\3"), ("^WH", "W"), ("^X", "S"), ("MB$", "M"), ("B", "b"),
        ("C(H)", r"x\1"), ("C([IEY])", r"s\1"), ("C", "k"), ("D(G[IEY])", r"j\1"), ("D", "t"), ("G(H.)", r"-\1"), ("G(N)$", r"-\1"), ("G([IEY])", r"j\1"), ("G", "k"),
        ("P(H)", r"f\1"), ("P", "p"), ("S(H)", r"x\1"), ("S", "s"), ("T(H)", r"0\1"), ("T(I[OA])", r"x\1"), ("T", "t"),
        ("([^AEIOU])H([AEIOU])", r"\1h\2"), ("([^AEIOU])H([AEIOU])", r"\1h\2"), ("H", "-"), ("^W", "w"), ("W([AEIOU])", r"w\1"), ("W", "-"),
        ("^Y", "y"), ("Y([AEIOU])", r"y\1"), ("Y", "-"), ("Q", "k"), ("V", "f"), ("Z", "s"), ("X", "ks"), ("(.)[AEIOU]+", r"\1"), ("-", ""),
    ]
    sql = f"regexp_replace(upper({word}), '[^A-Z]', '', 'g')"
    for pattern, sounds in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{sounds}', 'g')"
    sql = f"upper({sql})"
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0":
        sql = f"regexp_replace({sql}, '{c}{c}+', '{c}', 'g')"
    return sql


@query(f"SELECT name, array_to_string(list_transform(string_split(name, ' '), lambda w: {_sound_sql('w')}), ' ') AS sound FROM (SELECT DISTINCT p_name || ' ' || lower(p_type) || ' ' || CASE p_size % 8 WHEN 0 THEN 'knight' WHEN 1 THEN 'chemistry' WHEN 2 THEN 'wheel' WHEN 3 THEN 'xerox' WHEN 4 THEN 'thumb' WHEN 5 THEN 'edge' WHEN 6 THEN 'nation' ELSE 'physics' END AS name FROM part)")
def metaphone_keys(spark, sf_dir):
    """keys by sound of distinct names, inside the JVM."""
    words = ("knight", "chemistry", "wheel", "xerox", "thumb", "edge", "nation", "physics")
    word = F.element_at(F.array(*map(F.lit, words)), F.col("p_size") % 8 + 1)
    n = _part(spark, sf_dir).select(text.nfkc(F.concat_ws(" ", "p_name", F.lower("p_type"), word)).alias("name")).distinct()
    return n.select("name", similarity.sound_key(F.col("name")).alias("sound"))


@query()
def matching_ratios(spark, sf_dir):
    """ratios of matching blocks over distinct names."""
    n = _part(spark, sf_dir).select(F.col("p_name").alias("name")).distinct()
    return n.select("name", F.round(similarity.matching_ratio(F.col("name"), F.reverse("name")), 4).alias("mirror"))
