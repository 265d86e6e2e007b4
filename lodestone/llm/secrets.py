"""Secret spans, judged by corpus-wide ownership frequency.  DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored, text_or_empty

#: The base kinds' patterns (Java syntax).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A maximal run of at least 20 key characters with a digit, a lower-case and an upper-case letter.
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
#: What a text must hold before any span is looked for.
_ANY = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}", MIXED)
BASE = ("assign", "access", "hex")
#: The kind that the method adds, after the base kinds in order.
OWNED = "owned"
#: A value seen under more owners, or in more repositories, than this is a widely copied example.
MAX_OWNERS, MAX_REPOS = 2, 3
_PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|x{6}|1234567"
_OPEN, _CLOSE, _OTHER = chr(0xE000), chr(0xE001), chr(0xFFFD)


#: Arrays are folded in steps of this many, since a fold copies what it has gathered.
_STEP = 256


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(values: Column) -> Column:
    """An array in slices of ``_STEP``; ``values`` must be a column or a lambda's variable."""
    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / _STEP).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * _STEP + 1, F.lit(_STEP)))


def _scan(values: Column, join) -> Column:
    """For each element of an array of integers, what ``join`` makes of 0 and those before it.

    ``join`` must be associative.  Slices are folded one by one, so work is linear in the array.
    """
    none = F.array().cast("array<int>")

    def fold(some: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), none.alias("out"))
        return F.aggregate(some, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def by_slice(slices: Column) -> Column:
        whole = F.transform(slices, lambda part: F.aggregate(part, F.lit(0), join))
        return F.flatten(F.zip_with(slices, fold(whole, F.lit(0)), fold))

    return _let(values, lambda v: _let(_steps(v), by_slice))


def _matches(text: Column, pattern: str, kind: str, rank: int, value) -> Column:
    """Leftmost non-overlapping matches as structs, in code points.

    Matches are put between two private-use characters (any in the text become another character
    that no pattern matches, so places stay), and the pieces' lengths add up to the places.
    """
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, _OTHER * 2), F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))

    def found(pieces: Column) -> Column:
        starts = _scan(F.transform(pieces, lambda p: F.char_length(p)), lambda a, b: a + b)
        placed = F.zip_with(pieces, starts, lambda p, at: F.struct(at.alias("start"), (at + F.char_length(p)).alias("end"), p.alias("piece")))
        return F.filter(placed, lambda _, i: i % 2 == 1)

    spans = _let(F.split(marked, f"[{_OPEN}{_CLOSE}]", -1), found)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), value(s["piece"]).alias("value")))


def _candidates(text: Column) -> Column:
    """All candidate spans of a text: the base kinds', and mixed runs that only the method may add."""
    whole = lambda piece: piece
    assign = F.filter(_matches(text, ASSIGN, "assign", 0, lambda p: F.regexp_extract(p, ASSIGN, 2)), lambda s: F.char_length(s["value"]) >= 12)
    others = [_matches(text, p, k, r, whole) for k, r, p in (("access", 1, ACCESS), ("hex", 2, HEX), (OWNED, 3, MIXED))]
    return F.concat(assign, *others)


def may_hold_secrets(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in _ANY])


def _live_looking(value: Column) -> Column:
    return ~value.rlike(_PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= 6)


def _judged(held: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(row, spans) for rows (row, owner, repo, found): each span with its value's owners.

    Value hashes are first made distinct by repository, so a value that a third of all rows copy
    is one row a repository before it meets itself; then repositories and owners are counted.
    """
    spans = held.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s", F.sha2("s.value", 256).alias("hash"))
    by_owner = spans.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    owners = stored(by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos")), "secret-owners")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos) & _live_looking(F.col("s.value"))
    one = F.struct("s.start", "s.rank", "s.kind", "s.end", "hash", "n_owners", "n_repos", live.alias("live"))
    known = spans.join(owners, "hash").select("row", one.alias("span")).where("span.rank < 3 or span.live")
    return known.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _split(docs: DataFrame, text_col: str, owner_col: str, repo_cols: tuple[str, ...], keep: list[Column], max_owners: int, max_repos: int) -> tuple[DataFrame, DataFrame]:
    """(kept) of rows without any candidate, and (kept, spans) of the others with judged spans.

    One pass over the texts finds the candidates and stores them with what is kept of a row; only
    rows that have some (few) are shuffled.
    """
    text = text_or_empty(text_col)
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])
    found = F.when(may_hold_secrets(text), _candidates(text))
    scanned = stored(docs.select(F.monotonically_increasing_id().alias("row"), owner.alias("owner"), repo.alias("repo"), found.alias("found"), F.struct(*keep).alias("kept")), "secret-candidates")
    some = F.coalesce(F.size("found"), F.lit(0)) > 0
    held = scanned.where(some)
    spans = _judged(held.select("row", "owner", "repo", "found"), max_owners, max_repos)
    return scanned.where(~some).select("kept"), held.select("row", "kept").join(spans, "row", "left").select("kept", "spans")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row a document: doc_id and spans, by start and then kind.

    A span has kind, start and end (code points, end exclusive), its value's hash, in how many
    repositories and under how many owners the whole corpus has the value, and ``live``: the value
    looks like a credential, and at most ``max_owners`` and ``max_repos`` repositories have it,
    unlike widely copied examples.  Base spans (assign, access, hex) are always there; mixed
    key-like runs are added, as kind "owned", only where live.  Values themselves are not kept.

    Null texts count as empty and have no spans; a null owner or repository is one of its own;
    repeated rows are rows; other columns are ignored; an empty table gives no rows.  Work is
    linear in a text's length and matches.
    """
    clear, held = _split(docs, text_col, owner_col, repo_cols, [F.col(id_col).alias("doc_id")], max_owners, max_repos)
    kind = held.schema["spans"].dataType
    some = held.select("kept.doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    return clear.select("kept.doc_id", F.array().cast(kind).alias("spans")).unionByName(some)


def span_list(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column) -> Column:
    """The text with the characters of the spans, which are in order of their starts and may
    overlap, as asterisks.  Each slice of spans takes its part out of the text once."""

    def segments(live: Column) -> Column:
        before = _scan(F.transform(live, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return F.zip_with(live, before, lambda s, at: F.struct(at.alias("begin"), F.greatest(s["start"], at).alias("from"), F.greatest(s["end"], at).alias("to")))

    def of_slice(part: Column) -> Column:
        first, last = F.get(part, F.lit(0))["begin"], F.element_at(part, -1)["to"]
        one = lambda own: F.transform(part, lambda s: F.concat(F.substring(own, s["begin"] - first + 1, s["from"] - s["begin"]), F.repeat(F.lit("*"), s["to"] - s["from"])))
        return F.array_join(_let(F.substring(text, first + 1, last - first), one), "")

    def whole(found: Column) -> Column:
        return F.concat(F.array_join(F.transform(_steps(found), of_slice), ""), F.substring(text, F.element_at(found, -1)["to"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, _let(segments(spans), whole)).otherwise(text)


def mask_live(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """The same rows and columns, with each character of a live secret replaced by an asterisk."""
    clear, held = _split(docs, text_col, owner_col, repo_cols, [F.col(f"`{c}`") for c in docs.columns], max_owners, max_repos)
    held = held.select("kept", F.filter("spans", lambda s: s["live"]).alias("live"))
    masked = _masked(F.col(f"kept.`{text_col}`"), F.col("live"))
    columns = [F.coalesce(masked, F.col(f"kept.`{text_col}`")).alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns]
    return clear.select("kept.*").unionByName(held.select(*columns))
