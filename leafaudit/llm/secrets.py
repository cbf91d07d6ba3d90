"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Rule matches are found in each row. Besides them, opaque tokens (long, of letters and
digits) are candidates: all values are counted over the corpus by distinct repository
and owner. A value of few owners looks like a live credential, a widely copied one like
an example; candidates that look live are reported beside the rule matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafaudit.llm.common import document_key, fresh, same_key, stored, text_or_empty
from leafaudit.operators.ordered import join_unique

KEYWORD = r"(?i:(?=[psta])(password|passwd|secret|token|api_?key))"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Rules in report order: name, pattern, least length of the value and the group that is the value.
RULES = [("assign", ASSIGN, 6, 2), ("access", r"AKIA[A-Z0-9]{16,}", 20, 0), ("hex", r"[0-9a-f]{24,}", 24, 0)]
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}"
OPAQUE_ORDER = len(RULES)
BLOCK = 256
SPAN = "struct<start:bigint,`order`:int,stop:bigint,value:string>"


def in_blocks(items: Column, fold: Callable[[Column], Column]) -> Column:
    """Cut an array into blocks of BLOCK items and apply fold to each."""
    last = F.greatest(F.size(items) - 1, F.lit(0))
    numbers = F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int"))
    return F.transform(numbers, lambda b: fold(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))


def running_spans(pairs: Column) -> Column:
    """Spans from (gap before, length, value) of the matches of a text. Positions are summed
    within blocks and then over blocks, so that a text of very many matches stays cheap."""
    start_type = "struct<at:bigint,out:array<struct<start:bigint,stop:bigint,value:string>>>"

    def one(block: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>").alias("out")).cast(start_type)

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            stop = start + x["length"]
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value")))).alias("out")).cast(start_type)

        return F.aggregate(block, zero, step)

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<struct<start:bigint,stop:bigint,value:string>>>").alias("out"))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["stop"] + acc["at"]).alias("stop"), s["value"].alias("value")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    return F.flatten(F.aggregate(in_blocks(pairs, one), zero, join)["out"])


def gaps_and_values(text: str, hits: str, pattern: str, group: int) -> Column:
    """(gap before, length, value) of each match, from what stands between the matches."""
    gaps = F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>"))
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    both = F.zip_with(gaps, F.col(hits), lambda g, m: F.struct(F.char_length(g).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("length"), value(m).alias("value")))
    return F.filter(both, lambda x: x["length"].isNotNull())


def long_spans(pairs: str, order: int, least: int) -> Column:
    """Spans of the matches whose value has that length at least."""
    found = F.when(F.size(pairs) > 0, running_spans(F.col(pairs)))
    kept = F.filter(found, lambda s: F.char_length(s["value"]) >= least)
    spans = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["stop"].alias("stop"), s["value"].alias("value")))
    return F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))


def find_spans(docs: DataFrame, text: str) -> tuple[DataFrame, str, str]:
    """Adds two arrays of spans (start, order of the rule, stop, value): rule matches in
    order, and candidates of the opaque pattern. Offsets count code points."""
    rules = [*RULES, ("opaque", OPAQUE, 20, 0)]
    hits, pairs, spans = ([f"{n}{i}" for i in range(len(rules))] for n in fresh("hits", "pairs", "spans"))
    out = docs.withColumns({h: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for h, (_, p, _, _) in zip(hits, rules, strict=True)})
    out = out.withColumns({pair: gaps_and_values(text, h, p, g) for pair, h, (_, p, _, g) in zip(pairs, hits, rules, strict=True)}).drop(*hits)
    out = out.withColumns({span: long_spans(pair, order, rule[2]) for order, (span, pair, rule) in enumerate(zip(spans, pairs, rules, strict=True))}).drop(*pairs)
    base, more = fresh("base", "candidates")
    out = out.withColumn(base, F.array_sort(F.concat(*spans[:OPAQUE_ORDER])))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    covered = lambda s: F.exists(F.col(base), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    out = out.withColumn(more, F.filter(F.col(spans[OPAQUE_ORDER]), lambda s: mixed(s) & ~covered(s)))
    return out.drop(*spans), base, more


def ownership(values: DataFrame) -> DataFrame:
    """(value_id, n_repositories, n_owners) from rows (value_id, owner, repository). A
    repository counts once, for its least owner; counted by value and owner first, so a
    value that is everywhere stays spread."""
    once = values.groupBy("value_id", "repository").agg(F.min(F.struct(F.col("owner").isNull().alias("unknown"), "owner")).alias("o"))
    by_owner = once.groupBy("value_id", "o").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_id").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, *, most_owners: int = 2, most_repositories: int = 8, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """Spans of secrets in every whole text: one row per document with
    (doc_id, text_hash, base, spans). base holds the rule matches; spans also the opaque
    tokens that look live: those of at most most_owners owners and most_repositories
    repositories. A repository is a distinct text (exact copies count once) unless a column
    is named. Both are arrays of (start, order, stop, value, n_repositories, n_owners), by
    start and rule.

    A missing owner column makes all rows of one owner. Null texts count as empty; a null owner or repository is one of its own. Repeated
    rows each give a row. Offsets are code points, the end excluded. Nothing is capped."""
    (rid,) = fresh("rid")
    owned = F.col(owner).cast("string") if owner in docs.columns else F.lit(None).cast("string")
    kept_in = F.col(repository).cast("string") if repository else F.xxhash64(text_or_empty(text)).cast("string")
    picked = docs.select(*document_key(doc_id, text), owned.alias("owner"), kept_in.alias("repository"), text_or_empty(text).alias("body"))
    found, base, more = find_spans(picked, "body")
    rows = stored(found.drop("body").withColumnsRenamed({base: "base", more: "candidates"}), "secret-spans").withColumn(rid, F.monotonically_increasing_id())
    spans = rows.select(rid, "doc_id", "text_hash", "owner", "repository", F.explode(F.concat("base", "candidates")).alias("s")).withColumn("value_id", F.sha2(F.col("s.value"), 256))
    counts = ownership(spans.select("value_id", "owner", "repository"))
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    judged = join_unique(spans, counts, "value_id").filter((F.col("s.order") < OPAQUE_ORDER) | live)
    entry = F.struct("s.start", "s.order", "s.stop", "s.value", "n_repositories", "n_owners")
    per_row = judged.groupBy(rid).agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.array_sort(F.collect_list(entry)).alias("spans"))
    kind = dict(per_row.dtypes)["spans"]
    none = rows.filter((F.size("base") == 0) & (F.size("candidates") == 0)).select("doc_id", "text_hash", F.array().cast(kind).alias("spans"))
    # rows whose candidates are all widely copied, and that have no rule match, have left per_row
    dropped = rows.filter((F.size("base") == 0) & (F.size("candidates") > 0)).join(per_row, rid, "left_anti").select("doc_id", "text_hash", F.array().cast(kind).alias("spans"))
    every = per_row.drop(rid).unionByName(none).unionByName(dropped)
    return every.select("doc_id", "text_hash", F.filter("spans", lambda s: s["order"] < OPAQUE_ORDER).alias("base"), "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(n) for n, *_ in RULES], F.lit("opaque"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"], s["stop"])), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    count = lambda order: F.size(F.filter("base", lambda s: s["order"] == order)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{name}") for i, (name, *_) in enumerate(RULES)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def masked(body: Column, spans: Column, mask: str) -> Column:
    """The text with each run of overlapping spans replaced by the mask."""
    kind = "struct<at:bigint,out:array<string>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = body.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(before, F.lit(mask))).alias("out")).cast(kind)
        same = F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out")).cast(kind)
        return F.when(s["start"] >= acc["at"], new).otherwise(same)

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), body.substr((acc["at"] + 1).cast("int"), F.char_length(body)))

    return F.aggregate(spans, zero.cast(kind), step, end)


def mask_secrets(docs: DataFrame, *, mask: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with every span of scan_secrets replaced by the mask; all columns and
    rows stay, and texts without secrets (null ones too) stay as they are."""
    found = scan_secrets(docs, doc_id=doc_id, text=text, **options).filter(F.size("spans") > 0)
    key, digest, spans = fresh("key", "digest", "spans")
    found = found.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.col("spans").alias(spans))
    keyed = docs.withColumns({key: F.col(doc_id), digest: F.xxhash64(text_or_empty(text))})
    joined = keyed.join(found, same_key(keyed, found, [key, digest]), "left").select(*[keyed[c] for c in docs.columns], found[spans])
    body = F.when(F.col(spans).isNull(), F.col(text)).otherwise(masked(F.col(text), F.col(spans), mask))
    return joined.withColumn(text, body).drop(spans)
