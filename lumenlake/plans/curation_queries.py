"""Queries of the curation operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.config import Settings
from lumenlake.operators import curation as C
from lumenlake.operators import trips as R
from lumenlake.operators.density import face_clusters as _face_clusters
from lumenlake.operators.density import place_clusters as _place_clusters
from lumenlake.operators.persist import rebuild
from lumenlake.plans.library_queries import SQL_QUALITY, Tables, sql_haversine, sql_hex_distance, sql_label
from lumenlake.functions import scalars as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(Tables(spark, sf))

        run.__name__ = f.__name__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_E = f"""e AS (SELECT id, relative_path, file_hash, perceptual_hash, capture_at, capture_source, width, height, coalesce(face_count, 0) AS face_count,
  CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, CASE WHEN NOT isnan(longitude) THEN longitude END AS longitude, nullif(place_city, '') AS place, {SQL_QUALITY} AS quality FROM photos WHERE active AND analysis_status = 'done')"""
_DATED = "dated AS (SELECT * FROM e WHERE capture_at IS NOT NULL)"
#: of members m(key, kind, title, id, quality, capture_at, latitude, longitude)
_SUMMARY = """SELECT key, kind, title, count(*) AS photos, round(least(1.0, avg(quality) FILTER (WHERE rk <= 10) * 0.8 + least(count(*), 30) / 150), 6) AS score, min(capture_at) AS starts_at, max(capture_at) AS ends_at,
round(avg(latitude) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL), 6) AS latitude, round(avg(longitude) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL), 6) AS longitude, max(id) FILTER (WHERE rk = 1) AS cover_photo_id
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY quality DESC, id DESC) AS rk FROM m) GROUP BY key, kind, title"""


def _place_of(rows: str, group: str, order: str) -> str:
    """CTE ``named(group, place)``: the most frequent place, of equals the one seen first."""
    return f"""counted AS (SELECT {group}, place, count(*) AS n, min({order}) AS seen FROM {rows} WHERE place IS NOT NULL GROUP BY 1, 2),
named AS (SELECT {group}, place FROM counted QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY n DESC, seen) = 1)"""


def _collections(members: DataFrame) -> DataFrame:
    c = C.collections_of(members)[0]
    return c.select("key", "kind", "title", "photos", F.round("score", 6).alias("score"), "starts_at", "ends_at", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "cover_photo_id")


_EVENTS = f"""{_E}, {_DATED},
gaps AS (SELECT *, epoch_us(capture_at) - lag(epoch_us(capture_at)) OVER o AS gap, capture_at::DATE <> lag(capture_at::DATE) OVER o AS other, lag(latitude) OVER o AS la, lag(longitude) OVER o AS lo FROM dated WINDOW o AS (ORDER BY capture_at, id)),
events AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 8 * 3600000000 OR (other AND gap > 3.5 * 3600000000) OR (gap > 3600000000 AND coalesce({sql_haversine('la', 'lo', 'latitude', 'longitude')} > 180, false)) THEN 1 ELSE 0 END) OVER (ORDER BY capture_at, id) AS event FROM gaps)"""


@query(f"WITH {_EVENTS} SELECT id, event::BIGINT AS event FROM events")
def events_split(t: Tables) -> DataFrame:
    return C.split_events(C.eligible(t.photos)).select("id", "event")


@query(
    f"""WITH {_EVENTS}, {_place_of('events', 'event', 'row(capture_at, id)')},
best AS (SELECT event, count(*) AS n, max(quality) AS q, min(capture_at) AS s, max(capture_at) AS z, arg_min(id, row(capture_at, id)) AS first FROM events GROUP BY 1 HAVING count(*) >= 4 ORDER BY n DESC, q DESC, event LIMIT 250),
m AS (SELECT 'event:' || first AS key, 'event' AS kind, coalesce(named.place, 'Notable day') || ' — ' || {sql_label('s', 'z')} AS title, events.id, quality, capture_at, latitude, longitude FROM events JOIN best USING (event) LEFT JOIN named USING (event))
{_SUMMARY}"""
)
def event_collections(t: Tables) -> DataFrame:
    return _collections(C.event_members(C.eligible(t.photos)))


_BURSTS = f"""{_E}, {_DATED}, gaps AS (SELECT *, epoch_us(capture_at) - lag(epoch_us(capture_at)) OVER (ORDER BY capture_at, id) AS gap FROM dated),
runs AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 45000000 THEN 1 ELSE 0 END) OVER (ORDER BY capture_at, id) AS burst FROM gaps),
bursts AS (SELECT *, count(*) OVER (PARTITION BY burst) AS size, first_value(id) OVER (PARTITION BY burst ORDER BY capture_at, id) AS first FROM runs QUALIFY size >= 3)"""


@query(f"WITH {_BURSTS} SELECT id, burst::BIGINT AS burst, size FROM bursts")
def bursts(t: Tables) -> DataFrame:
    return C.split_bursts(C.eligible(t.photos)).select("id", "burst", "size")


@query(
    f"""WITH {_BURSTS}, best AS (SELECT burst, max(size) AS n, min(capture_at) AS s FROM bursts GROUP BY 1 ORDER BY n DESC, burst LIMIT 100),
m AS (SELECT 'series:' || first AS key, 'series' AS kind, 'Series of ' || n || ' — ' || strftime(s, '%b %-d, %Y %H:%M') AS title, id, quality, capture_at, latitude, longitude FROM bursts JOIN best USING (burst))
{_SUMMARY}"""
)
def burst_collections(t: Tables) -> DataFrame:
    return _collections(C.burst_members(C.eligible(t.photos)))


@query(f"WITH {_BURSTS} SELECT 'series:' || first AS key, arg_min(id, row(-quality, capture_at, id)) AS cover_photo_id FROM bursts GROUP BY first")
def burst_covers(t: Tables) -> DataFrame:
    return C.burst_covers(C.eligible(t.photos))


@query(
    f"""WITH {_E}, {_DATED}, best AS (SELECT strftime(capture_at, '%m-%d') AS md, count(*) AS n, min(id) AS seen, min(capture_at) AS s FROM dated GROUP BY 1 HAVING count(*) >= 8 AND count(DISTINCT year(capture_at)) >= 2 ORDER BY n DESC, seen LIMIT 40),
m AS (SELECT 'recurring:' || md AS key, 'notable-date' AS kind, 'Recurring date — ' || strftime(s, '%B %-d') AS title, id, quality, capture_at, latitude, longitude FROM dated JOIN best ON md = strftime(capture_at, '%m-%d')) {_SUMMARY}"""
)
def recurring_dates(t: Tables) -> DataFrame:
    return _collections(C.recurring_members(C.eligible(t.photos)))


#: A calendar by rule: fixed days of each year.
_FESTIVE = ((1, 1, "New Year"), (5, 1, "Spring day"), (6, 24, "Midsummer"), (12, 24, "Winter eve"), (12, 31, "Year end"))


def _calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(date(y, m, d), n) for y in range(1980, 2031) for m, d, n in _FESTIVE], "day date, name string")


@query(
    f"""WITH {_E}, {_DATED}, cal AS (SELECT make_date(y, mo, d) AS day, name FROM (SELECT unnest(range(1980, 2031)) AS y) CROSS JOIN (VALUES {', '.join(f"({m}, {d}, '{n}')" for m, d, n in _FESTIVE)}) v(mo, d, name)),
h AS (SELECT dated.*, name FROM dated JOIN cal ON cal.day = capture_at::DATE QUALIFY count(*) OVER (PARTITION BY name) >= 3),
m AS (SELECT 'holiday:' || substr(sha1(name), 1, 10) AS key, 'notable-date' AS kind, name AS title, id, quality, capture_at, latitude, longitude FROM h) {_SUMMARY}"""
)
def holiday_groups(t: Tables) -> DataFrame:
    photos = C.eligible(t.photos)
    return _collections(C.holiday_members(photos, _calendar(photos.sparkSession)))


@query(
    f"""WITH {_E}, {_DATED}, d AS (SELECT *, capture_at::DATE AS day FROM dated), {_place_of('d', 'day', 'id')},
best AS (SELECT day, count(*) AS n, min(id) AS seen FROM d GROUP BY 1 HAVING count(*) >= 6 QUALIFY row_number() OVER (PARTITION BY year(day) ORDER BY count(*) DESC, min(id)) <= 8),
m AS (SELECT 'notable-day:' || day AS key, 'notable-date' AS kind, coalesce('Big day in ' || named.place, 'A day worth remembering') || ' — ' || strftime(day, '%b %-d, %Y') AS title, id, quality, capture_at, latitude, longitude FROM d JOIN best USING (day) LEFT JOIN named USING (day)) {_SUMMARY}"""
)
def notable_days(t: Tables) -> DataFrame:
    return _collections(C.notable_day_members(C.eligible(t.photos)))


@query(
    f"""WITH {_E}, f AS (SELECT *, nullif(regexp_extract(relative_path, '^(.*)/[^/]*$', 1), '') AS folder FROM e),
best AS (SELECT folder, count(*) AS n, min(id) AS seen FROM f WHERE folder IS NOT NULL GROUP BY 1 HAVING count(*) BETWEEN 5 AND 1000 AND lower(regexp_extract(folder, '[^/]*$')) NOT IN ('camera', 'dcim', 'images', 'photos', 'pictures', 'uploads') ORDER BY n DESC, seen LIMIT 80),
m AS (SELECT 'folder:' || substr(sha1(folder), 1, 16) AS key, 'folder' AS kind, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(regexp_extract(folder, '[^/]*$'), '[_-]', ' ', 'g')), '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title,
  id, quality, capture_at, latitude, longitude FROM f JOIN best USING (folder)) {_SUMMARY}"""
)
def folders(t: Tables) -> DataFrame:
    return _collections(C.folder_members(C.eligible(t.photos)))


# -- people ----------------------------------------------------------------------------

_SEEN = "seen AS (SELECT DISTINCT cluster_id, photo_id AS id FROM faces WHERE cluster_id IS NOT NULL AND photo_id IS NOT NULL)"


@query(
    f"""WITH {_E}, {_SEEN}, r AS (SELECT e.*, cluster_id FROM e JOIN seen USING (id)), al AS (SELECT cluster_id, count(*) AS al FROM seen GROUP BY 1),
best AS (SELECT cluster_id, count(*) AS n, min(capture_at) AS s, max(capture_at) AS z, any_value(al) AS al FROM r JOIN al USING (cluster_id) GROUP BY 1 HAVING count(*) >= 3 AND min(capture_at) IS NOT NULL ORDER BY al DESC, cluster_id LIMIT 100),
b AS (SELECT *, date_diff('day', s::DATE, z::DATE) <= 14 AND n <= 40 AS short FROM best),
m AS (SELECT 'person:' || cluster_id AS key, CASE WHEN short THEN 'visitor' ELSE 'people' END AS kind, CASE WHEN short THEN 'Possible visitor — ' || strftime(s, '%b %Y') ELSE 'Person ' || cluster_id END AS title, id, quality, capture_at, latitude, longitude FROM r JOIN b USING (cluster_id)) {_SUMMARY}"""
)
def people_collections(t: Tables) -> DataFrame:
    return _collections(C.people_members(C.eligible(t.photos), t.faces.filter("photo_id is not null")))


@query(
    f"""WITH {_E}, {_SEEN}, r AS (SELECT id, cluster_id FROM e JOIN seen USING (id) QUALIFY count(*) OVER (PARTITION BY id) BETWEEN 2 AND 8),
pairs AS (SELECT a.id, a.cluster_id AS l, b.cluster_id AS r FROM r a JOIN r b ON a.id = b.id AND a.cluster_id < b.cluster_id),
best AS (SELECT * FROM (SELECT l, r, count(*) AS n FROM pairs GROUP BY 1, 2 ORDER BY n DESC, l, r LIMIT 40) WHERE n >= 3),
x AS (SELECT e.*, l, r, min(capture_at) OVER (PARTITION BY l, r) AS s, max(capture_at) OVER (PARTITION BY l, r) AS z FROM e JOIN pairs USING (id) JOIN best USING (l, r)),
m AS (SELECT 'together:' || l || ':' || r AS key, CASE WHEN coalesce(date_diff('day', s::DATE, z::DATE) <= 14, false) THEN 'visitor' ELSE 'people' END AS kind,
  CASE WHEN coalesce(date_diff('day', s::DATE, z::DATE) <= 14, false) THEN 'Possible visit together — ' || strftime(s, '%b %Y') ELSE 'People ' || l || ' & ' || r || ' together' END AS title, id, quality, capture_at, latitude, longitude FROM x) {_SUMMARY}"""
)
def together_pairs(t: Tables) -> DataFrame:
    return _collections(C.together_members(C.eligible(t.photos), t.faces))


_VECTORS = """v AS (SELECT id, photo_id, embedding::DOUBLE[128] AS x FROM faces WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0)"""


def _dbscan_sql(points: str, near: str, least: int, weight: str = "1") -> str:
    """CTEs ``labels(id, label)`` from points(id, ...) and near(a, b), both ways."""
    return f"""{points}, near AS ({near}), core AS (SELECT v.id FROM v LEFT JOIN near ON near.a = v.id GROUP BY v.id HAVING count(near.b) + 1 >= {least}),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS other FROM core UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
cores AS (SELECT id, min(other) AS label FROM reach GROUP BY 1),
labels AS (SELECT * FROM cores UNION ALL SELECT a, min(label) FROM near JOIN cores ON cores.id = near.b WHERE a NOT IN (SELECT id FROM core) GROUP BY 1)"""


@query(
    f"""WITH RECURSIVE {_dbscan_sql(_VECTORS, 'SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND array_cosine_similarity(p.x, q.x) >= 1 - 0.38', 3)}
SELECT v.id AS face_id, photo_id, min(v.id) OVER (PARTITION BY label) AS cluster_id FROM labels JOIN v ON v.id = labels.id"""
)
def face_clusters(t: Tables) -> DataFrame:
    return _face_clusters(t.faces)


_LOCATED = "v AS (SELECT id, latitude AS la, longitude AS lo FROM e WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)"


@query(
    f"""WITH RECURSIVE {_E}, {_dbscan_sql(_LOCATED, f"SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND {sql_haversine('p.la', 'p.lo', 'q.la', 'q.lo')} <= 25", 5)}
SELECT id, min(id) OVER (PARTITION BY label) AS cluster_id FROM labels"""
)
def place_clusters(t: Tables) -> DataFrame:
    return _place_clusters(C.eligible(t.photos))


@query()
def place_collections(t: Tables) -> DataFrame:
    photos = C.eligible(t.photos)
    return _collections(R.place_members(photos, _place_clusters(photos)))


# -- duplicates ------------------------------------------------------------------------


@query(
    f"""WITH {_E}, g AS (SELECT file_hash, count(*) AS copies, row_number() OVER (ORDER BY min(id)) AS group_number FROM e WHERE coalesce(file_hash, '') <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT id, file_hash, copies, group_number FROM e JOIN g USING (file_hash)"""
)
def duplicates_exact(t: Tables) -> DataFrame:
    return C.exact_duplicates(C.eligible(t.photos)).select("id", "file_hash", "copies", "group_number")


_NEAR = f"""{_E}, h AS (SELECT id, file_hash, lower(lpad(trim(perceptual_hash), 16, '0')) AS h FROM e WHERE regexp_full_match(trim(perceptual_hash), '[0-9a-fA-F]{{1,16}}')),
firsts AS (SELECT h, min(id) AS id, arg_min(file_hash, id) AS file_hash FROM h GROUP BY 1),
edges AS (SELECT p.id AS photo_id, r.id AS prior_id FROM h p JOIN firsts r ON r.id < p.id AND {sql_hex_distance('p.h', 'r.h')} <= 7 AND NOT (coalesce(p.file_hash, '') <> '' AND coalesce(r.file_hash, '') = p.file_hash))"""


@query(f"WITH {_NEAR} SELECT photo_id, prior_id FROM edges")
def near_duplicate_edges(t: Tables) -> DataFrame:
    return C.near_duplicate_edges(C.eligible(t.photos))


@query(
    f"""WITH RECURSIVE {_NEAR}, b AS (SELECT photo_id AS a, prior_id AS b FROM edges UNION SELECT prior_id, photo_id FROM edges),
reach AS (SELECT DISTINCT a AS photo_id, a AS other FROM b UNION SELECT r.photo_id, b.b FROM reach r JOIN b ON b.a = r.other) SELECT photo_id, min(other) AS group_id FROM reach GROUP BY 1"""
)
def near_duplicate_groups(t: Tables) -> DataFrame:
    return C.near_duplicate_groups(C.eligible(t.photos))


# -- travel ----------------------------------------------------------------------------


@query(
    f"""WITH {_E}, p AS (SELECT id, capture_at AS ts, capture_at::DATE AS day, latitude AS la, longitude AS lo FROM e WHERE capture_source IN ('exif', 'filename') AND capture_at IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180),
cells AS (SELECT day, round_even(la * 10, 0) AS x, round_even(lo * 10, 0) AS y, count(*) AS n, min(row(ts, id)) AS seen, arg_min(la, row(ts, id)) AS sa, arg_min(lo, row(ts, id)) AS so FROM p GROUP BY 1, 2, 3),
seeds AS (SELECT day, sa, so FROM cells QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, seen) = 1),
near AS (SELECT p.*, sa, so FROM p JOIN seeds USING (day) WHERE {sql_haversine('sa', 'so', 'la', 'lo')} <= 30),
mid AS (SELECT day, median(la) AS ma, median(((lo - so + 180) % 360 + 360) % 360 - 180 + so) AS mo FROM near GROUP BY 1)
SELECT day, round(la, 6) AS latitude, round(lo, 6) AS longitude FROM near JOIN mid USING (day) QUALIFY row_number() OVER (PARTITION BY day ORDER BY {sql_haversine('ma', 'mo', 'la', 'lo')}, ts, id) = 1"""
)
def location_days(t: Tables) -> DataFrame:
    rows = C.eligible(t.photos).filter("capture_source in ('exif', 'filename')")
    return R.location_days(rows, Settings().trip_home_radius_km).select("day", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query()
def trips(t: Tables) -> DataFrame:
    return _collections(R.trip_members(C.eligible(t.photos)))


# -- all -------------------------------------------------------------------------------


@query()
def highlights(t: Tables) -> DataFrame:
    return _collections(C.highlight_members(C.eligible(t.photos)))


def _everything(t: Tables) -> DataFrame:
    photos = C.materialize(C.eligible(t.photos), "eligible")
    faces = t.faces.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    clusters = C.materialize(_face_clusters(faces), "face-clusters")
    members, failed = C.all_members(photos, clusters, calendar=_calendar(photos.sparkSession), trips=lambda: R.trip_members(photos), places=lambda: R.place_members(photos, _place_clusters(photos)))
    if failed:
        raise C.BuilderFailure(failed)
    return members


_DUPLICATES = f"""{_E}, hashed AS (SELECT *, dense_rank() OVER (ORDER BY seen) AS n FROM (SELECT *, min(id) OVER (PARTITION BY file_hash) AS seen, count(*) OVER (PARTITION BY file_hash) AS copies FROM e WHERE file_hash <> '') WHERE copies > 1),
exact AS (SELECT *, row_number() OVER (ORDER BY n, relative_path, id) AS rk FROM hashed)"""


@query(
    f"""WITH {_DUPLICATES} SELECT 'duplicates:exact' AS key, id AS photo_id, rk AS rank, round(quality, 6) AS score, 'byte-identical duplicate group ' || n AS reason,
(SELECT max(n) FROM exact) || ' byte-identical groups. Nothing is deleted; use this as a review list.' AS description, (SELECT id FROM exact ORDER BY quality DESC, rk LIMIT 1) AS cover_photo_id FROM exact"""
)
def duplicate_collections(t: Tables) -> DataFrame:
    """The links of the collection of exact duplicates, with what the collection says of itself."""
    collections, links = C.collections_of(C.duplicate_members(C.eligible(t.photos)))
    links = links.filter("key = 'duplicates:exact'").select("key", "photo_id", "rank", F.round("score", 6).alias("score"), F.col("prefix").alias("reason"))
    return links.join(F.broadcast(collections.filter("key = 'duplicates:exact'").select("key", "description", "cover_photo_id")), "key")  # one row


@query(
    f"""WITH {_E}, {_DATED}, days AS (SELECT strftime(capture_at, '%m-%d') AS md, count(*) AS n, count(DISTINCT year(capture_at)) AS years, min(year(capture_at)) AS a, max(year(capture_at)) AS z, min(id) AS seen FROM dated GROUP BY 1),
best AS (SELECT * FROM days WHERE n >= 8 AND years >= 2 ORDER BY n DESC, seen LIMIT 40),
folder AS (SELECT *, nullif(regexp_extract(relative_path, '^(.*)/[^/]*$', 1), '') AS folder FROM e), counted AS (SELECT folder, count(*) AS n, min(id) AS seen FROM folder WHERE folder IS NOT NULL GROUP BY 1),
album AS (SELECT * FROM counted WHERE n BETWEEN 5 AND 1000 AND lower(regexp_extract(folder, '[^/]*$')) NOT IN ('camera', 'dcim', 'images', 'photos', 'pictures', 'uploads') ORDER BY n DESC, seen LIMIT 80)
SELECT 'recurring:' || md AS key, 'Photos on this calendar date across ' || years || ' years (' || a || '–' || z || '). This may reveal an anniversary or tradition.' AS description FROM best
UNION ALL SELECT 'folder:' || substr(sha1(folder), 1, 16), n || ' analyzed photos already grouped in source folder ' || folder || '. The folder is treated as a useful human-authored album clue.' FROM album"""
)
def collection_descriptions(t: Tables) -> DataFrame:
    photos = C.eligible(t.photos)
    rows = C.recurring_members(photos).unionByName(C.folder_members(photos))
    return C.suggestions(rows, t.photos)[0].select(F.col("collection_key").alias("key"), "description")


def _rebuilt(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The whole chain: all builders, their suggestions, and the stored collections with their decisions."""
    return rebuild(t.collections, t.collection_photos, *C.suggestions(_everything(t), t.photos), t.photos)


@query()
def curation_rebuilt_collections(t: Tables) -> DataFrame:
    return _rebuilt(t)[0].select("id", "collection_key", "kind", "title", "description", "status", "cover_photo_id")


@query()
def curation_rebuilt_links(t: Tables) -> DataFrame:
    return _rebuilt(t)[1]


@query()
def curation_collections(t: Tables) -> DataFrame:
    return _collections(_everything(t))


@query()
def curation_links(t: Tables) -> DataFrame:
    links = C.suggestions(_everything(t), t.photos)[1]
    return links.select(F.col("collection_key").alias("key"), "photo_id", F.col("rank_no").alias("rank"), F.round("score", 6).alias("score"), "reason")
