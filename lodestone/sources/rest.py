"""Paged REST APIs as a data source, and downloads by URL; both retry with a linear back-off."""

from __future__ import annotations

import json
import re
import time
from collections import Counter, deque
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from hashlib import md5
from http.client import HTTPException, InvalidURL
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import urlopen

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions import images
from lodestone.shipping import ship
from lodestone.storage import new_folder

#: Statuses that are worth another try.
RETRY = (429, 500, 502, 503, 504)


#: Bytes of downloaded bodies that go out together, requests of a task under way at once, seconds
#: that a silent server is waited for.
FLUSH, IN_FLIGHT, TIMEOUT = 32 << 20, 4, 60.0


def get_bytes(url: str, tries: int = 5, backoff: float = 2.0, fetch=None, sleep=time.sleep, timeout: float = TIMEOUT) -> bytes:
    """The answer's body; a failure that may pass is tried again after a growing pause.

    | failure | what happens |
    |-|-|
    | status 429, 500, 502, 503, 504 | tried again |
    | no connection, connection lost, body cut off, silence for ``timeout`` seconds | tried again |
    | any other status | raised at once |
    | a URL that is none | raised at once |
    """
    fetch = fetch or (lambda u: urlopen(u, timeout=timeout))
    for attempt in range(1, tries + 1):
        try:
            with fetch(url) as answer:
                return answer.read()
        except HTTPError as e:
            if e.code not in RETRY or attempt == tries:
                raise
        except InvalidURL:
            raise
        except (OSError, HTTPException):  # URLError, time-outs and lost connections are OSErrors
            if attempt == tries:
                raise
        sleep(backoff * attempt)
    raise ValueError("tries must be positive")


def get_json(url: str, params: dict, tries: int = 5, backoff: float = 2.0, fetch=urlopen, sleep=time.sleep):
    return json.loads(get_bytes(f"{url}?{urlencode(params)}" if params else url, tries, backoff, fetch, sleep))


class Keys(InputPartition):
    """The keys of one series of requests."""

    def __init__(self, keys: list[str]):
        super().__init__(keys)
        self.keys = keys


def _at(row: dict, path: str):
    """The value at a dotted path (a number is a place in a list), None where there is none."""
    for step in path.split("."):
        if isinstance(row, list):
            row = row[int(step)] if int(step) < len(row) else None
        else:
            row = row.get(step) if isinstance(row, dict) else None
    return row


#: Shards of an exclusion set that a worker keeps, and keys that a shard is to hold.
_SHARDS, _SHARD_KEYS = 32, 1 << 16


def stored_keys(keys: DataFrame, key: str) -> str:
    """Stores the distinct keys for ``KeySet`` and gives the folder's path.

    A key is the first 64 bits of its text's MD5, so a billion keys are 8 GB in the shared folder; they
    are sorted in shards by their first hexadecimal digits.  Null keys are left out.
    """
    h = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 16)
    hashed = keys.where(F.col(key).isNotNull()).select(h.alias("h")).distinct()
    digits = min(4, max(1, -(-max(hashed.count() // _SHARD_KEYS, 1).bit_length() // 4)))
    path = f"{new_folder(keys.sparkSession, 'keys')}-{digits}"
    rows = hashed.select(F.substring("h", 1, digits).alias("shard"), F.unhex("h").alias("digest"))
    rows.repartition("shard").sortWithinPartitions("shard", "digest").write.partitionBy("shard").parquet(path)
    return path


class KeySet:
    """What ``stored_keys`` has stored; a worker reads the shards that it asks for and keeps a few."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.at = fs.FileSystem.from_uri(path)
        self.digits = int(path.rpartition("-")[2])
        self.shards: dict[str, np.ndarray] = {}

    def _shard(self, name: str) -> np.ndarray:
        from pyarrow import dataset, fs

        found = self.shards.pop(name, None)
        if found is None:
            folder = f"{self.at}/shard={name}"
            there = self.files.get_file_info(folder).type == fs.FileType.Directory
            column = dataset.dataset(folder, filesystem=self.files, format="parquet").to_table(columns=["digest"]).column("digest") if there else []
            found = np.frombuffer(b"".join(v.as_py() for v in column), ">u8")
        while len(self.shards) >= _SHARDS:
            del self.shards[next(iter(self.shards))]
        self.shards[name] = found
        return found

    def __contains__(self, key) -> bool:
        h = md5(str(key).encode(), usedforsecurity=False).hexdigest()[:16]
        shard, n = self._shard(h[: self.digits]), int(h, 16)
        at = int(np.searchsorted(shard, np.uint64(n)))
        return at < len(shard) and int(shard[at]) == n


def _slug(name: str) -> str:
    """As ``text.slugify``."""
    return re.sub("[^a-z0-9]+", "-", name.strip(" ").lower()).strip("-")


_last_request = [0.0]


def _pages(key: str, o: dict):
    """The rows of each page of one series of requests in turn."""
    size, by_offset = int(o.get("pagesize", 200)), o.get("paging", "page") == "offset"
    url, fixed = o["url"], json.loads(o.get("params", "{}"))
    if o.get("keyin") == "path":
        url = f"{url.rstrip('/')}/{quote(key, safe=',')}"
    elif o.get("keyin") == "params":
        fixed = json.loads(key) | fixed
    else:
        fixed = {o.get("keyparam", "taxon_id"): key} | fixed
    for n in range(int(o.get("pages", 4))):
        place = {} if o.get("paging") == "none" else {"limit": size, "offset": n * size} if by_offset else {"page": n + 1, "per_page": size}
        wait = _last_request[0] + float(o.get("pause", 0)) - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        _last_request[0] = time.monotonic()
        try:
            answer = get_json(url, fixed | place, int(o.get("tries", 5)), float(o.get("backoff", 2.0)))
        except (OSError, HTTPException, ValueError):
            if o.get("failures") != "skip":
                raise
            return
        rows = (answer.get(o.get("results", "results")) or []) if o.get("results") != "" else [answer]
        yield rows
        if not rows or (answer.get("endOfRecords") if by_offset else len(rows) < size):
            return


def accepted(key: str, o: dict):
    """The rows that one series of requests lets through, as JSON; see ``PagedRest`` for the options."""
    cap, group, target = int(o.get("cap", 0)), o.get("capfield"), int(o.get("target", 0))
    where, there = json.loads(o.get("where", "{}")), [p for p in o.get("present", "").split(",") if p]
    excluded = {path: KeySet(at) for path, at in json.loads(o.get("exclude", "{}")).items()}
    once, seen = o.get("distinct"), set()
    taken, given = Counter(), 0
    for rows in _pages(key, o):
        for row in rows:
            if any(_at(row, path) != value for path, value in where.items()) or any(_at(row, path) in (None, "") for path in there):
                continue
            name = _at(row, group) if group else None
            if group and not name:
                continue
            name = _slug(str(name)) if group else None
            if group and cap and taken[name] >= cap:
                continue
            if any((v := _at(row, path)) is not None and v in known for path, known in excluded.items()):
                continue
            if once:
                mark = json.dumps(_at(row, once))
                if mark in seen:
                    continue
                seen.add(mark)
            taken[name] += 1
            given += 1
            yield json.dumps(row)
            if given == target:
                return


class PagedReader(DataSourceReader):
    """One series of requests a group of keys; see ``PagedRest`` for the options."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        keys = [k for k in self.options["keys"].split(",") if k]
        n = int(self.options.get("keysperrequest", 1))
        return [Keys(keys[i : i + n]) for i in range(0, len(keys), n)]

    def read(self, partition):
        key = ",".join(partition.keys)
        for row in accepted(key, self.options):
            yield key, row


class PagedRest(DataSource):
    """``spark.read.format("paged_rest")``: rows (key, value), a JSON document each, for the readers.

    A partition is one series of requests.  Options: ``url``; ``keys`` (comma-separated), of which
    ``keysperrequest`` go into one request, as the parameter ``keyparam``, or (``keyin`` = path) at
    the end of the URL, or (``keyin`` = params) each a JSON object of parameters; ``params`` (JSON) for
    each request, say the order or a cutoff; ``paging`` = page (until a page has fewer than
    ``pagesize`` rows), offset (until ``endOfRecords``) or none, for ``pages`` pages at most, ``pause``
    seconds after one another in a task; ``results``, the field that holds the rows (empty: the answer
    is one row); ``failures`` = skip ends a series whose request fails, else the job fails.

    Only accepted rows count: ``where`` (JSON: dotted path to value) and ``present`` (dotted paths,
    comma-separated) let rows through; ``exclude`` (JSON: dotted path to a folder of
    ``stored_keys``) holds rows back; of rows with an equal value at ``distinct`` the first counts.  Of
    these at most ``cap`` a slug of ``capfield`` (rows without one are left out), and a series
    ends with its ``target``-th row.

    ``paged`` does the same for keys in a table, of which the driver never holds a list.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema):
        return PagedReader(dict(self.options))


class Pager:
    """A table function: the accepted rows of a key's series of requests."""

    def eval(self, key: str, options: str):
        if key is not None:
            for row in accepted(key, json.loads(options)):
                yield (row,)


def _grouped(n: int):
    """Keys, ``n`` a row."""

    def run(batches):
        held: list[str] = []
        for batch in batches:
            held += [k for k in batch.column(0).to_pylist() if k is not None]
            while len(held) >= n:
                yield pa.RecordBatch.from_pydict({"key": [",".join(held[:n])]})
                held = held[n:]
        if held:
            yield pa.RecordBatch.from_pydict({"key": [",".join(held)]})

    return run


def _told(options: dict) -> dict[str, str]:
    return {k: json.dumps(v) if isinstance(v, dict) else str(v) for k, v in options.items() if v is not None}


def paged(keys: DataFrame, key: str, url: str, **options) -> DataFrame:
    """``keys`` joined laterally with the rows that each key's series of requests gives (``value``).

    The options are those of ``PagedRest``.  With ``keysperrequest`` the result has only ``key``
    (the request's keys, comma-separated) and ``value``.  ``keys.repartition(n)`` says how many tasks
    ask at once; each pauses between its requests, so n tasks make n / ``pause`` requests a second.
    """
    ship(keys.sparkSession)
    n = int(options.pop("keysperrequest", 1))
    if n > 1:
        keys, key = keys.select(F.col(key).cast("string").alias("key")).mapInArrow(_grouped(n), "key string"), "key"
    pager = F.udtf(Pager, returnType="value string")
    return keys.lateralJoin(pager(F.col(key).cast("string").outer(), F.lit(json.dumps(_told({"url": url} | options)))))


def _source(spark: SparkSession, url: str, keys, **options) -> DataFrame:
    """(key, value): keys are a few given ones, or the first column of a table.  A task waits a
    second between its requests, unless told otherwise."""
    options = {"pause": 1.0} | options
    if isinstance(keys, DataFrame):
        first = keys.columns[0]
        return paged(keys.select(F.col(f"`{first}`").cast("string").alias("key")), "key", url, **options)
    ship(spark)
    spark.dataSource.register(PagedRest)
    return spark.read.format("paged_rest").options(url=url, keys=",".join(map(str, keys)), **_told(options)).load()


#: Fixed values, with the parameters' names below: what is asked of an observation.
_RESEARCH = {"quality_grade": "research", "photos": "true", "order_by": "created_at"}
_PHOTO = "photos.0.id,photos.0.url"


def _excluding(photos: DataFrame | None, uuids: DataFrame | None = None) -> dict | None:
    """Exclusion sets of (photo) ids and observations' uuids: the first column of each table."""
    given = {"photos.0.id": photos, "uuid": uuids}
    return {path: stored_keys(df, df.columns[0]) for path, df in given.items() if df is not None} or None


def newest_observations(spark: SparkSession, url: str, taxa, target: int | None = None, pages: int = 4, **options) -> DataFrame:
    """Up to ``target`` research observations of each taxon, newest first: those whose first photo
    has a URL, each photo once."""
    return _source(spark, url, taxa, pages=pages, target=target, present="photos.0.url", distinct="photos.0.id", params=_RESEARCH | {"order": "desc"}, **options)


def observations_since(spark: SparkSession, url: str, taxa, cutoff: str, target: int | None = None, pages: int = 10, exclude_photos: DataFrame | None = None, **options) -> DataFrame:
    """Up to ``target`` research observations a taxon made on the cutoff's day or later, oldest
    first.  Observations whose first photo is among the excluded do not count."""
    return _source(spark, url, taxa, pages=pages, target=target, present=_PHOTO, exclude=_excluding(exclude_photos), params=_RESEARCH | {"order": "asc", "created_d1": cutoff}, **options)


def diverse_observations(spark: SparkSession, url: str, taxa, cutoff: str, target: int | None, without: str | None = None, cap: int | None = 15, pages: int = 40, exclude_photos: DataFrame | None = None, exclude_uuids: DataFrame | None = None, **options) -> DataFrame:
    """As ``observations_since``, of species rank only and at most ``cap`` a species.

    Excluded photos and observations count towards neither the cap nor the target.
    """
    params = _RESEARCH | {"order": "asc", "created_d1": cutoff} | ({"without_taxon_id": without} if without else {})
    return _source(spark, url, taxa, pages=pages, target=target, cap=cap, capfield="taxon.name", present=_PHOTO, where={"taxon.rank": "species"}, exclude=_excluding(exclude_photos, exclude_uuids), params=params, **options)


def specimen_payloads(names: DataFrame, url: str, limit: int, genus: str = "genus", species: str = "species", **options) -> DataFrame:
    """``names`` with ``value``, the payload of specimen images of each genus and species, for
    ``readers.specimen_images``.  A name whose request fails has none."""
    asked = F.to_json(F.struct(F.col(genus).alias("genus"), F.col(species).alias("species"), F.lit(max(3 * limit, 30)).alias("limit")))
    rows = paged(names.withColumn("_asked", asked), "_asked", url, keyin="params", paging="none", pages=1, results="", failures="skip", **{"pause": 1.0} | options)
    return rows.drop("_asked")


def observations_by_uuid(spark: SparkSession, url: str, uuids, batch: int = 100, **options) -> DataFrame:
    """Exactly the given observations, ``batch`` a request."""
    return _source(spark, url, uuids, keyparam="uuid", keysperrequest=batch, pagesize=batch, pages=1, **options)


def taxa_by_id(spark: SparkSession, url: str, ids, batch: int = 30, **options) -> DataFrame:
    """(taxon_id, common_name) of taxa that have one, ``batch`` a request with the ids in its path."""
    rows = _source(spark, url, ids, keyin="path", keysperrequest=batch, pages=1, **options)
    v = F.from_json("value", "id long, preferred_common_name string")
    return rows.select(v["id"].alias("taxon_id"), v["preferred_common_name"].alias("common_name")).where("common_name <> ''")


def occurrences(spark: SparkSession, url: str, keys, pages: int = 10, size: int = 100, **options) -> DataFrame:
    """Occurrences with still images of each usage key, by offset and limit."""
    return _source(spark, url, keys, keyparam="taxonKey", paging="offset", pagesize=size, pages=pages, params={"mediaType": "StillImage"}, **options)


def body_or_none(url: str | None, tries: int = 3, backoff: float = 1.5, timeout: float = TIMEOUT) -> bytes | None:
    """What the URL gives, or None where it gives nothing: every failure of ``get_bytes``, an empty
    body, no URL."""
    try:
        return (get_bytes(url, tries, backoff, timeout=timeout) or None) if url else None
    except (OSError, HTTPException, ValueError):
        return None


def with_bodies(fetch, in_flight: int = IN_FLIGHT, flush: int = FLUSH):
    """For ``mapInArrow``: the last column's value is replaced by ``content``, what ``fetch`` gives for it.

    A task has ``in_flight`` requests under way and passes rows on once ``flush`` bytes have come,
    so it never holds the bodies of a whole batch.  Rows keep their order.
    """

    def run(batches):
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                values = batch.column(batch.num_columns - 1).to_pylist()
                asked = deque(pool.submit(fetch, v) for v in values[:in_flight])
                start, held, bodies = 0, 0, []
                for n in range(len(values)):
                    body = asked.popleft().result()
                    if n + in_flight < len(values):
                        asked.append(pool.submit(fetch, values[n + in_flight]))
                    bodies.append(body)
                    held += len(body or b"")
                    if held >= flush or n + 1 == len(values):
                        part = batch.slice(start, len(bodies))
                        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(bodies, pa.binary())], [*batch.schema.names[:-1], "content"])
                        start, held, bodies = n + 1, 0, []

    return run


def downloaded(df: DataFrame, url: str = "url", tries: int = 3, backoff: float = 1.5, timeout: float = TIMEOUT) -> DataFrame:
    """``df`` with ``content`` and ``sha256``: what each row's URL gives, from the executors.

    A download that fails, or is empty, is tried again where that may help (see ``get_bytes``) and is
    null then; no URL, however broken, fails the job.  The caller drops such rows (``where("content
    is not null")``).  ``repartition`` before sets how many downloads run at once, ``IN_FLIGHT`` a task.
    """
    ship(df.sparkSession)
    fetch = partial(body_or_none, tries=tries, backoff=backoff, timeout=timeout)
    kept = [f"`{c}`" for c in df.columns]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = df.select(*kept, F.col(url).alias("__lodestone_url")).mapInArrow(with_bodies(fetch), f"{fields}, content binary")
    return rows.withColumn("sha256", F.sha2("content", 256))


def enriched(candidates: DataFrame, category: str, source: str, url: str = "url") -> DataFrame:
    """Candidates that could be downloaded, with digest, sharpness and what they are sampled for."""
    rows = downloaded(candidates, url).where("content is not null")
    return rows.withColumns({"blur_score": images.blur_score("content"), "category": F.lit(category), "source": F.lit(source)})
