"""From conversations to candidates, claims and reviews."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import privacy, text

MIN_USER_CHARS, MIN_PROSE = 2000, 0.45
REVIEW_REASONS = ("claims_extracted", "coursework", "transient", "third_party", "repo_state", "duplicate", "personal_ephemera", "sensitive", "other")
AUTOMATION = r"(?i)^\s*<(scheduled|automated)-task(\s|>)"


class Rejected(ValueError):
    """A batch that isn't taken, with the reasons."""


# ---------------------------------------------------------------- turns and candidates


def dedup_turns(turns: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Turn rows (doc, idx, role, text, ..) without those that repeat an earlier one's role and text in their document."""
    first = Window.partitionBy(doc, "role", text.strip(F.col("text"))).orderBy("idx")
    return turns.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def distinct_turns(turns: Column) -> Column:
    """The same inside a document's array of turns: sorted by role and text, the first of each stays, and they are put in order again."""
    keyed = F.array_sort(F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), text.strip(t["text"]).alias("key"), i.alias("i"), t.alias("t"))))
    same = lambda a, b: a["role"].eqNullSafe(b["role"]) & a["key"].eqNullSafe(b["key"])
    first = text.let(keyed, lambda s: F.filter(s, lambda x, i: (i == 0) | ~same(x, F.get(s, i - 1))))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))), lambda x: x["t"])


def user_turns(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["role"] == "user")


def user_text(turns: Column) -> Column:
    """User turns joined by blank lines; summaries by a machine left out."""
    own = F.filter(turns, lambda t: (t["role"] == "user") & ~t["machine_summary"])
    return F.array_join(F.transform(own, lambda t: t["text"]), "\n\n")


def user_chars(turns: Column) -> Column:
    """Characters of user turns; those of a machine's summary count half. Cut to a whole number once, at the end."""
    return F.floor(F.aggregate(user_turns(turns), F.lit(0.0), lambda s, t: s + F.length(t["text"]) * F.when(t["machine_summary"], F.lit(0.5)).otherwise(F.lit(1.0)))).cast("bigint")


def show_user_text(turns: Column, max_chars: int = 40_000) -> Column:
    """User turns with their day, for extraction."""
    said = F.filter(user_turns(turns), lambda t: text.strip(t["text"]) != "")
    line = lambda t: F.concat(F.lit("["), F.coalesce(F.date_format(t["ts"], "yyyy-MM-dd"), F.lit("????-??-??")), F.lit("]"), F.when(t["machine_summary"], F.lit(" [MASCHINELLE ZUSAMMENFASSUNG]")).otherwise(F.lit("")), F.lit(" "), t["text"])
    return F.substring(F.array_join(F.transform(said, line), "\n\n"), 1, max_chars)


def distillable() -> Column:
    """Own primary sources: no foreign material, no mirrored notes, no automation prompts."""
    mirrored = (F.col("source") == "memory") & F.col("project").isin("notes", "private")
    automated = F.exists(user_turns(F.col("turns")), lambda t: t["text"].rlike(AUTOMATION))
    return (F.col("sensitivity") != privacy.COPYRIGHT) & ~mirrored & ~automated


def select(docs: DataFrame, limit: int | None = None, min_user_chars: int = MIN_USER_CHARS, min_prose: float = MIN_PROSE, project: str | None = None, today: date | None = None) -> DataFrame:
    """Candidates with their density: user characters times prose share times recency. The densest ``limit`` in order; 0 or None means all, in no order."""
    rows = docs.where(distillable())
    if project:
        rows = rows.where(text.contains_folded(F.col("project"), project))
    rows = text.once(rows, turns=distinct_turns(F.col("turns")))
    rows = rows.withColumn("user_chars", user_chars(F.col("turns"))).where(F.col("user_chars") >= min_user_chars)
    rows = text.once(rows, prose=text.prose_ratio(user_text(F.col("turns")))).where(F.col("prose") >= min_prose)
    score = F.col("user_chars") * F.col("prose") * text.recency(F.col("started_day"), F.lit(today or date.today()), text.DISTILL_HALF_LIFE)
    out = rows.select("doc_id", "project", "source", F.col("started_day").alias("started_at"), "user_chars", "prose", score.alias("score"), text.source_fingerprint(F.col("turns")).alias("source_fingerprint"), "sensitivity")
    return out.orderBy(F.desc("score"), "doc_id").limit(limit) if limit else out


# ---------------------------------------------------------------- reviews


def matched_reviews(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """``candidates`` with the review that applies: that of the same doc_id, else the first of the same signature.

    A review of the same id shadows one found by signature, even where its fingerprint differs.
    """
    cols = ["source_fingerprint", "reason"]
    exact = reviews.dropDuplicates(["doc_id"]).select("doc_id", F.struct(*cols).alias("_exact"))
    sig = text.doc_signature(F.col("doc_id"))
    by_sig = reviews.withColumn("_sig", sig).where("_sig is not null").groupBy("_sig").agg(F.min_by(F.struct(*cols), "doc_id").alias("_similar"))
    rows = candidates.withColumn("_sig", sig).join(exact, "doc_id", "left").join(by_sig, "_sig", "left")
    return rows.withColumn("review", F.coalesce("_exact", "_similar")).drop("_exact", "_similar", "_sig")


def pending(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates whose present revision no review covers."""
    rows = matched_reviews(candidates, reviews)
    return rows.where(F.col("review").isNull() | (F.col("review.source_fingerprint") != F.col("source_fingerprint"))).drop("review")


# ---------------------------------------------------------------- stores


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by identity ``keys`` (null equals null), the later one winning; ``new`` has a column seq that orders it."""
    rows = old.withColumns({"_batch": F.lit(0), "seq": F.lit(0).cast("bigint")}).unionByName(new.withColumn("_batch", F.lit(1)))
    best = Window.partitionBy(*keys).orderBy(F.desc("_batch"), F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_batch", "seq")


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(added, replaced): distinct identities of ``new`` that are not, or are, in ``old``."""
    a, b = new.select(*keys).distinct().alias("a"), old.select(*keys).distinct().withColumn("_old", F.lit(True)).alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left").agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_old").isNotNull()).alias("replaced"))


CLAIM_KEYS = ["topic", "key", "source_doc_id", "stated_on"]  #: not the text: a reworded claim replaces its former self


def remove_sources(store: DataFrame, sources: DataFrame, key: str = "source_doc_id") -> DataFrame:
    return store.join(sources.select(F.col(sources.columns[0]).alias(key)), key, "left_anti")


def resolved_sources(refs: DataFrame, docs: DataFrame, ref: str = "source_doc_id") -> DataFrame:
    """``refs`` with the document each means: that of the id, else the only one of its signature; nulls if there is none."""
    sig = lambda c: text.doc_signature(F.col(c))
    exact = docs.select(F.col("doc_id").alias(ref), F.struct("doc_id", "sensitivity").alias("_exact"))
    lone = docs.withColumn("_sig", sig("doc_id")).where("_sig is not null").groupBy("_sig").agg(F.count("*").alias("_n"), F.first(F.struct("doc_id", "sensitivity")).alias("_moved")).where("_n = 1").drop("_n")
    rows = refs.withColumn("_sig", sig(ref)).join(exact, ref, "left").join(lone, "_sig", "left")
    found = F.coalesce("_exact", "_moved")
    return rows.withColumns({"found_doc_id": found["doc_id"], "source_sensitivity": found["sensitivity"]}).drop("_sig", "_exact", "_moved")


def route(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """``claims`` with layer (clean or private) by their source's sensitivity, and error where they can't be routed: no source, a
    copyright source, or a topic of both layers."""
    rows = resolved_sources(claims, docs)
    levels = rows.groupBy("topic").agg(F.count_distinct("source_sensitivity").alias("_levels"))
    error = (
        F.when(F.col("source_sensitivity").isNull(), F.lit("source missing")).when(F.col("source_sensitivity") == privacy.COPYRIGHT, F.lit("copyright source"))
        .when(F.col("_levels") > 1, F.lit("mixed topic"))
    )
    layer = F.when(F.col("source_sensitivity") == privacy.NDA, F.lit("private")).otherwise(F.lit("clean"))
    return rows.join(levels, "topic").withColumns({"layer": layer, "error": error}).drop("_levels")


def foreign_claims(batch: DataFrame, candidates: DataFrame) -> DataFrame:
    """Claims of a batch whose source isn't a candidate."""
    return batch.join(candidates.select(F.col("doc_id").alias("source_doc_id")), "source_doc_id", "left_anti")


def add_claims(store: DataFrame, batch: DataFrame, candidates: DataFrame) -> DataFrame:
    """The store with a batch of claims (with seq); the whole batch is rejected if a source isn't a candidate."""
    foreign = foreign_claims(batch, candidates).select("source_doc_id").distinct().limit(10).collect()
    if foreign:
        raise Rejected("sources that aren't candidates: " + ", ".join(r[0] for r in foreign))
    return upsert(store, batch, CLAIM_KEYS)


def review_errors(batch: DataFrame, candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, error) of reviews that contradict the stores; no row if the batch can be taken."""
    rows = batch.join(candidates.select("doc_id", F.lit(True).alias("_known")), "doc_id", "left")
    rows = rows.join(claims.select(F.col("source_doc_id").alias("doc_id")).distinct().withColumn("_claimed", F.lit(True)), "doc_id", "left")
    says = F.col("reason") == "claims_extracted"
    error = (
        F.when(F.col("_known").isNull(), F.lit("not a candidate")).when(~F.col("reason").isin(*REVIEW_REASONS), F.lit("unknown reason"))
        .when(says != F.col("_claimed").isNotNull(), F.lit("reason contradicts claims"))
    )
    return rows.select("doc_id", error.alias("error")).where("error is not null")


def add_reviews(store: DataFrame, batch: DataFrame, candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """The store with a batch of reviews (with seq), their fingerprints set from the candidates; all or none."""
    wrong = review_errors(batch, candidates, claims).limit(10).collect()
    if wrong:
        raise Rejected("; ".join(f"{r.doc_id}: {r.error}" for r in wrong))
    marked = batch.drop("source_fingerprint").join(candidates.select("doc_id", "source_fingerprint"), "doc_id").select(*batch.columns)
    return upsert(store, marked, ["doc_id"])


def progress(candidates: DataFrame, claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """(candidates, extracted, reviewed, open, topics), one row."""
    claimed = claims.select(F.col("source_doc_id").alias("doc_id")).distinct().withColumn("c", F.lit(True))
    done = matched_reviews(candidates, reviews).withColumn("r", F.col("review.source_fingerprint") == F.col("source_fingerprint"))
    rows = done.join(claimed, "doc_id", "left")
    reviewed = F.coalesce("r", F.lit(False))
    out = rows.agg(F.count("*").alias("candidates"), F.count_if(F.col("c")).alias("extracted"), F.count_if(reviewed).alias("reviewed"), F.count_if(~reviewed & F.col("c").isNull()).alias("open"))
    return out.crossJoin(F.broadcast(claims.agg(F.count_distinct("topic").alias("topics"))))  # two rows of one


# ---------------------------------------------------------------- conflicts and notes


def _latest_first() -> list[Column]:
    return [F.coalesce("stated_on", F.lit("0001-01-01").cast("date")).desc(), F.desc("source_doc_id"), F.desc("text")]


def resolve(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, superseded): of each topic and key the latest statement, and the older ones of other wording with what replaced them."""
    w = Window.partitionBy("topic", "key").orderBy(*_latest_first())
    rows = claims.withColumns({"_n": F.row_number().over(w), "_new": F.first(F.struct("text", "stated_on", "source_doc_id")).over(w)})
    current = rows.where("_n = 1").drop("_n", "_new")
    older = rows.where("_n > 1").where(text.strip(F.col("text")) != text.strip(F.col("_new.text")))
    return current, older.withColumns({"new_text": F.col("_new.text"), "new_stated_on": F.col("_new.stated_on"), "new_source_doc_id": F.col("_new.source_doc_id")}).drop("_n", "_new")


def source_numbers(claims: DataFrame) -> DataFrame:
    """(topic, source_doc_id, ref): Q1, Q2, .. in the order of the ids."""
    w = Window.partitionBy("topic").orderBy("source_doc_id")
    return claims.select("topic", "source_doc_id").distinct().withColumn("ref", F.concat(F.lit("Q"), F.row_number().over(w)))


#: Sections of a note by kind of claim, in order.
SECTIONS = (("entscheidung", "Entscheidungen"), ("fakt", "Fakten"), ("praeferenz", "Praeferenzen"), ("offen", "Offen"))


def _day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("ohne Datum"))


def note_bodies(claims: DataFrame) -> DataFrame:
    """(topic, body): sections of current claims, superseded pairs and sources as Markdown. All strings are made on the executors."""
    current, old = resolve(claims)
    refs = source_numbers(claims)
    keyed = current.join(refs, ["topic", "source_doc_id"])
    bullet = F.concat(
        F.lit("- **"), _day(F.col("stated_on")), F.lit("**: "), text.strip(F.col("text")), F.when(text.strip(F.col("rationale")) != "", F.concat(F.lit(", weil "), text.strip(F.col("rationale")))).otherwise(F.lit("")),
        F.when(F.col("confidence") == "medium", F.lit(" *(indirekt belegt)*")).otherwise(F.lit("")), F.lit(" ["), F.col("ref"), F.lit("]"),
    )
    place = F.struct(F.coalesce("stated_on", F.lit("0001-01-01").cast("date")).alias("d"), F.col("source_doc_id").alias("s"), bullet.alias("line"))
    lists = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, place)), asc=False).alias(k) for k, _ in SECTIONS]
    section = lambda k, head: F.when(F.size(k) > 0, F.concat(F.lit(f"\n## {head}\n\n"), F.array_join(F.transform(k, lambda p: p["line"]), "\n"), F.lit("\n"))).otherwise(F.lit(""))
    notes = keyed.groupBy("topic").agg(*lists).select("topic", F.concat(*[section(k, h) for k, h in SECTIONS]).alias("now"))
    new_refs = refs.select("topic", F.col("source_doc_id").alias("new_source_doc_id"), F.col("ref").alias("new_ref"))
    line = F.concat(
        F.lit("- **"), _day(F.col("stated_on")), F.lit("**: "), text.strip(F.col("text")), F.lit(" ["), F.col("ref"), F.lit("]\n  ersetzt am "), _day(F.col("new_stated_on")), F.lit(" durch: "),
        text.strip(F.col("new_text")), F.lit(" ["), F.col("new_ref"), F.lit("]\n"),
    )
    gone = old.join(refs, ["topic", "source_doc_id"]).join(new_refs, ["topic", "new_source_doc_id"])
    gone = gone.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("stated_on", F.lit("0001-01-01").cast("date")).alias("d"), F.col("source_doc_id").alias("s"), line.alias("line"))), asc=False).alias("g"))
    gone = gone.select("topic", F.concat(F.lit("\n## Ueberholt\n\n"), F.array_join(F.transform("g", lambda p: p["line"]), "")).alias("old"))
    number = F.substring("ref", 2, 10).cast("int")
    sources = refs.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), F.concat(F.lit("- **"), F.col("ref"), F.lit("** `corpus/"), F.col("source_doc_id"), F.lit("`\n")).alias("line")))).alias("q"))
    sources = sources.select("topic", F.concat(F.lit("\n## Quellen\n\n"), F.array_join(F.transform("q", lambda p: p["line"]), "")).alias("refs"))
    return notes.join(gone, "topic", "left").join(sources, "topic").select("topic", F.concat("now", F.coalesce("old", F.lit("")), "refs").alias("body"))


def topic_spans(claims: DataFrame) -> DataFrame:
    """(entity, topic, first_day, last_day, claims, open, line): a hub's row for each topic."""
    current, _ = resolve(claims)
    still = current.groupBy("topic").agg(F.count_if(F.col("kind") == "offen").alias("open"))
    rows = claims.groupBy("entity", "topic").agg(F.min("stated_on").alias("first_day"), F.max("stated_on").alias("last_day"), F.count("*").alias("claims")).join(still, "topic")
    span = F.when(F.col("first_day").isNull(), F.lit("ohne Datum")).when(F.col("first_day") == F.col("last_day"), _day(F.col("first_day"))).otherwise(F.concat(_day(F.col("first_day")), F.lit(" bis "), _day(F.col("last_day"))))
    line = F.concat(
        F.lit("- [["), text.slugify(F.col("topic"), 60), F.lit("|"), F.col("topic"), F.lit("]] — "), span, F.lit(", "), F.col("claims"), F.when(F.col("claims") == 1, F.lit(" Claim")).otherwise(F.lit(" Claims")),
        F.when(F.col("open") > 0, F.concat(F.lit(", "), F.col("open"), F.lit(" offen"))).otherwise(F.lit("")),
    )
    return rows.select("entity", "topic", "first_day", "last_day", "claims", "open", line.alias("line"))


def emission_errors(claims: DataFrame) -> DataFrame:
    """(subject, error): what forbids writing notes. No row: all can be written."""
    named = claims.withColumn("e", text.strip(F.col("entity")))
    several = named.groupBy("topic").agg(F.count_distinct("e").alias("n"), F.count_if(F.col("e") == "").alias("empty")).where("n <> 1 or empty > 0").select(F.col("topic").alias("subject"), F.lit("needs exactly one entity").alias("error"))
    slugs = named.select(text.slugify(F.col("e"), 60).alias("slug"), F.col("e").alias("name"), F.lit("entity").alias("what")).unionByName(named.select(text.slugify(F.col("topic"), 60).alias("slug"), F.col("topic").alias("name"), F.lit("topic").alias("what"))).distinct()
    clash = slugs.groupBy("slug").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names")).where("n > 1")
    return several.unionByName(clash.select(F.col("names").alias("subject"), F.concat(F.lit("share the file name "), F.col("slug")).alias("error")))


def provenance_errors(refs: DataFrame, docs: DataFrame, require_clean: bool = False, ref: str = "source_doc_id") -> DataFrame:
    """(ref, error) of references (store, ref) to unsafe, missing or forbidden documents."""
    rows = resolved_sources(refs.distinct(), docs, ref)
    level = F.col("source_sensitivity")
    error = (
        F.when(~text.safe_path(F.col(ref)), F.lit("unsafe path")).when(level.isNull(), F.lit("source missing"))
        .when(F.lit(require_clean) & (level != privacy.CLEAN), F.concat(F.lit("belongs in the private store: "), level)).when(level == privacy.COPYRIGHT, F.lit("copyright source"))
    )
    return rows.select(*refs.columns, error.alias("error")).where("error is not null")


def new_claims(claims: DataFrame, baseline: DataFrame) -> DataFrame:
    """Claims that the baseline doesn't have with the same source, key and text."""
    return claims.join(baseline.select("source_doc_id", "key", "text").distinct(), ["source_doc_id", "key", "text"], "left_anti").select(*claims.columns)


def leaks(docs: DataFrame, policy: privacy.Policy) -> DataFrame:
    """(doc_id, reason): documents that the gate refuses. Clean ones are classified again, and private ones must be nda."""
    whole = F.concat_ws("\n", "title", F.array_join(F.transform("turns", lambda t: t["text"]), "\n"))
    again = (F.col("sensitivity") == privacy.CLEAN) & (policy.classify(F.col("project"), whole) == privacy.NDA)
    private = (F.col("source") == "memory") & F.startswith(F.col("conv_id"), F.lit("private/")) & (F.col("sensitivity") != privacy.NDA)
    reason = F.when(again, F.lit("clean but confidential")).when(private, F.lit("private but not nda"))
    return docs.select("doc_id", reason.alias("reason")).where("reason is not null")


def layer_leaks(notes: DataFrame, docs: DataFrame, policy: privacy.Policy) -> DataFrame:
    """(subject, reason) of a vault's notes (rel, value): confidential text in the clean layers, secrets in the private one, and private notes that aren't documents."""
    own = F.startswith("rel", F.lit("private/"))
    level, secret = policy.classify(F.col("rel"), F.col("value")), privacy.has_secret(F.coalesce("value", F.lit("")))
    found = notes.select(F.col("rel").alias("subject"), F.when(~own & (level == privacy.NDA), F.lit("clean layer holds confidential text")).when(own & secret, F.lit("secret in the private layer")).alias("reason")).where("reason is not null")
    known = docs.where("source = 'memory'").select(F.col("conv_id").alias("rel"))
    return found.unionByName(notes.where(own).join(known, "rel", "left_anti").select(F.col("rel").alias("subject"), F.lit("private note without a document").alias("reason")))


def store_leaks(claims: DataFrame, docs: DataFrame, policy: privacy.Policy) -> DataFrame:
    """(subject, reason) of claims: text that is confidential though its source is clean, and sources that are missing or foreign."""
    rows = resolved_sources(claims, docs)
    said = F.concat_ws("\n", "topic", "key", "text", F.coalesce("rationale", F.lit("")))
    reason = (
        F.when(F.col("source_sensitivity").isNull(), F.lit("claim without a source")).when(F.col("source_sensitivity") == privacy.COPYRIGHT, F.lit("claim from foreign material"))
        .when((F.col("source_sensitivity") == privacy.CLEAN) & (policy.classify(F.col("entity"), said) == privacy.NDA), F.lit("clean claim holds confidential text"))
    )
    return rows.select(F.concat_ws(" ", "topic", "key", "source_doc_id").alias("subject"), reason.alias("reason")).where("reason is not null").distinct()
