"""The engine over a data folder: ingest, index, search and the stores."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe import schema
from mnemoframe.functions.privacy import NDA, Policy, has_email, has_secret
from mnemoframe.operators import distill, index, notes, search, segments, tables
from mnemoframe.sources import registry
from mnemoframe.sources.assemble import latest
from mnemoframe.sources.notes import note_files

#: Files that are read and published at once at most; more are read in turns, each of which is a version of its own.
MAX_PATHS = 10_000
#: Parts that the documents of a new data folder are dealt to by their ids. An ingest writes the parts anew that it changes.
BUCKETS = 64
#: Segments of the index up to which none are merged.
SEGMENTS = 8
#: Parts of the documents that are embedded one after the other.
SLICES = 16
VECTORS = "doc_id string, content_key string, chunk_no int, chunk string, embedding array<float>"


@dataclass
class Engine:
    """Tables below ``root``: docs, files, segments, dead, vectors, claims, reviews. Each is a folder of versions that are never changed; the newest
    manifest names one version of each (of docs one for each bucket, of segments several), so that what is published together is seen together or not at all."""

    spark: SparkSession
    root: str
    policy: Policy = Policy()

    # -- versioned tables

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p  # noqa: SLF001

    def _manifests(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self) -> dict:
        """Version of each table; docs: by bucket (version or none, run that wrote it); segments: what ``segments.load`` takes; indexed: the run that the index has seen."""
        done = self._manifests()
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{done[-1]}", wholetext=True).first().value) if done else {}

    def _run(self) -> int:
        """The number of the next version."""
        return (self._manifests() or [0])[-1] + 1

    def _publish(self, writes: dict[str, Callable[[str], object]], **marks: object) -> None:
        """Write new versions of some tables, then the manifest that names them. Of two runs at once, one fails here and has changed nothing."""
        number, now = self._run(), self._manifest() | marks
        for name, write in writes.items():
            now[name] = uuid.uuid4().hex
            write(f"{self.root}/{name}/{now[name]}")
        fs, ready = self._fs(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(ready)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not fs.rename(ready, self._fs(f"{self.root}/manifests/{number}")[1]):
            raise RuntimeError(f"another run has published version {number} of {self.root}")

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _current(self, name: str) -> str | None:
        version = self._manifest().get(name)
        return f"{self.root}/{name}/{version}" if version else None

    def _read(self, name: str, shape) -> DataFrame:
        path = self._current(name)
        return self.spark.read.schema(shape).parquet(f"{path}/t") if path else self.spark.createDataFrame([], shape)

    @staticmethod
    def _table(df: DataFrame) -> Callable[[str], object]:
        return lambda p: df.write.parquet(f"{p}/t")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self._manifest().get("buckets", BUCKETS))).cast("int")

    def _stored(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Documents of some buckets, or of all, with the run that wrote each."""
        versions = self._manifest().get("docs", {})
        paths = [f"{self.root}/docs/{v}/bucket={b}" for b, (v, _) in versions.items() if v and (buckets is None or int(b) in buckets)]
        shape = f"{schema.DOC}, run bigint"
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def docs(self) -> DataFrame:
        if "docs" not in self._manifest():
            raise FileNotFoundError(f"nothing has been ingested into {self.root}")
        return self._stored().drop("run")

    def claims(self) -> DataFrame:
        return self._read("claims", schema.CLAIM)

    def reviews(self) -> DataFrame:
        return self._read("reviews", schema.REVIEW)

    def files(self) -> DataFrame:
        """State of the files that have been read: (source, path, size, mtime_ns, ctime_ns, policy_version)."""
        return self._read("files", f"source string, {schema.FILE_STATE}")

    # -- ingest

    def ingest(self, source: str, path: str, dry_run: bool = False, limit: int | None = None, full: bool = False, **options: object) -> dict:
        """Read what is new or changed of a source, or was read under another policy; notes and lessons whose file is gone go.

        limit: look at so many files, by path, unchanged ones included. full: read all files whatever the state.
        A document of a session keeps its longest state, also against a version that is stored. Returns counts: those of
        ``tables.COUNTS``, files and changed (files that were read).
        """
        here = tables.cut_lineage(registry.files(self.spark, source, path))
        own = self.files().where(F.col("source") == source).drop("source")
        seen = here.orderBy("path").limit(limit) if limit else here
        todo = tables.cut_lineage(seen if full else tables.changed_files(seen, own, self.policy.signature))
        total = dict.fromkeys(tables.COUNTS, 0)
        n, done, last = todo.count(), 0, ""
        while True:
            paths = [r.path for r in todo.where(F.col("path") > last).select("path").orderBy("path").limit(MAX_PATHS).collect()]
            done += len(paths)
            last = paths[-1] if paths else last
            part = todo.where(F.col("path").between(paths[0], last)) if paths else todo.where(F.lit(False))
            counts = self._ingest(source, path, here, part, paths, dry_run, done == n, options)
            total = {k: total[k] + counts[k] for k in total}
            if done == n:
                return total | {"files": here.count(), "changed": n}

    def _ingest(self, source: str, path: str, here: DataFrame, part: DataFrame, paths: list[str], dry_run: bool, last: bool, options: dict) -> dict:
        """Read the files ``part`` and publish what has changed; of a mirrored source, those that are gone from ``here`` go with the last part."""
        run, shape, mirrored = self._run(), [*schema.columns(schema.DOC.split(", turns ")[0]), "turns"], source in tables.DERIVED
        if paths:
            new = tables.cut_lineage(latest(registry.read(self.spark, source, path, self.policy, only=paths, **options)).select(*shape))
        else:
            new = self.spark.createDataFrame([], schema.DOC)
        gone = None
        if mirrored:  # a file is a document: what its last state was called doesn't matter
            stored = self._stored().where(F.col("source") == source).select("doc_id", "conv_id")
            lost = stored.join(here.select(F.col("rel").alias("conv_id")), "conv_id", "left_anti") if last else stored.where(F.lit(False))
            lost = lost.select("doc_id").unionByName(stored.join(new.select("conv_id"), "conv_id", "left_semi").select("doc_id"))
            gone = tables.cut_lineage(lost.join(new.select("doc_id"), "doc_id", "left_anti"))  # what comes under the same id is replaced
        bucket = self._bucket()
        changed = new.select(bucket.alias("b")) if gone is None else new.select(bucket.alias("b")).unionByName(gone.select(bucket.alias("b")))
        touched = sorted(r.b for r in changed.distinct().collect())  # as many as there are buckets at most
        merged, counted = tables.merge(self._stored(touched), new, run, mirrored, gone)
        if dry_run:
            merged.write.format("noop").mode("overwrite").save()
            return counted.get
        state = self.files()
        after = tables.next_state(part, state.where(F.col("source") == source).drop("source").join(here.select("path"), "path", "left_semi"), self.policy.signature).withColumn("source", F.lit(source))
        files = state.where(F.col("source") != source).unionByName(after.select(*state.columns))
        version, size = uuid.uuid4().hex, self._manifest().get("buckets", BUCKETS)
        place, dealt = f"{self.root}/docs/{version}", max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(touched)))
        merged.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(dealt))).write.partitionBy("bucket").parquet(place)
        docs = self._manifest().get("docs", {}) | {str(b): [version if self._exists(f"{place}/bucket={b}") else None, run] for b in touched}
        self._publish({"files": self._table(files)}, docs=docs, buckets=size)
        return counted.get

    # -- index

    def reindex(self, encoder: index.Encoder | None = None) -> None:
        """Build the index anew, as one segment. Vectors of unchanged documents are taken over; those of others are made if there is an encoder."""
        docs, run = self.docs(), self._run() - 1
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        entry = {"path": path, "seq": run} | segments.write_segment(docs, path)
        writes = {} if encoder is None else {"vectors": self._table(self._embedded(self._vectors(), docs, encoder))}
        self._publish(writes, segments=[entry], dead=None, indexed=run)
        if encoder is not None:
            fs, p = self._fs(f"{self.root}/vectors_pending")
            fs.delete(p, True)

    def _refresh(self) -> None:
        """Index what has changed since: one new segment with the documents of later runs, the places of their former states and of documents that are gone listed as dead."""
        now = self._manifest()
        since, run, entries = now.get("indexed", 0), self._run() - 1, now.get("segments", [])
        touched = [int(b) for b, (_, r) in now["docs"].items() if r > since]
        stored = self._stored(touched)
        changed = tables.cut_lineage(stored.where(F.col("run") > since).drop("run"))
        dead = self._dead()
        if entries:
            old = segments.load(self.spark, entries, dead)
            still = stored.where(F.col("run") <= since).select("doc_id")
            gone = old.docs.where(self._bucket().isin(touched)).select("doc_id", *segments.PLACE).join(still, "doc_id", "left_anti")
            gone = segments.dead_rows(old, gone)
            dead = tables.cut_lineage(gone if dead is None else dead.unionByName(gone))
        if changed.take(1) or not entries:
            path = f"{self.root}/segments/{uuid.uuid4().hex}"
            entries = [*entries, {"path": path, "seq": run} | segments.write_segment(changed, path)]
        if len(entries) > SEGMENTS:  # the smaller half becomes one, without its dead
            small = sorted(entries, key=lambda e: e["docs"])[: SEGMENTS // 2 + 1]
            seqs = [e["seq"] for e in small]
            live = segments.load(self.spark, small, None if dead is None else dead.where(F.col("seg").isin(seqs))).docs
            path = f"{self.root}/segments/{uuid.uuid4().hex}"
            entries = [e for e in entries if e["seq"] not in seqs] + [{"path": path, "seq": max(seqs)} | segments.write_segment(live, path)]
            dead = None if dead is None else dead.where(~F.col("seg").isin(seqs))
        self._publish({} if dead is None else {"dead": self._table(dead)}, segments=entries, indexed=run)

    def _dead(self) -> DataFrame | None:
        return self._read("dead", "doc_id string, seg bigint, block bigint, bit int, dl bigint") if self._current("dead") else None

    def _vectors(self) -> DataFrame | None:
        return self._read("vectors", VECTORS) if self._current("vectors") else None

    def _embedded(self, before: DataFrame | None, docs: DataFrame, encoder: index.Encoder) -> DataFrame:
        """Vectors of all documents. New ones are made a slice of the documents at a time and kept at once, so that a run which breaks off goes on where it was."""
        path = f"{self.root}/vectors_pending"

        def so_far() -> DataFrame | None:
            kept = self.spark.read.schema(VECTORS).parquet(path) if self._exists(path) else None
            parts = [x.select(*index.VECTOR_COLUMNS) for x in (before, kept) if x is not None]
            return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

        for i in range(SLICES):
            part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == i)
            index.missing_vectors(so_far(), part, encoder).write.mode("append").parquet(path)
        return index.unchanged_vectors(so_far(), docs).select(*index.VECTOR_COLUMNS)

    def index(self, vectors: bool = False) -> segments.Index:
        """The index of the documents as they are: what came, changed or went since is indexed first, so nothing that was reclassified stays visible."""
        now = self._manifest()
        if any(run > now.get("indexed", 0) for _, run in now.get("docs", {}).values()) or not now.get("segments"):
            self.docs()
            self._refresh()
        return segments.load(self.spark, self._manifest()["segments"], self._dead(), self._vectors() if vectors else None)

    def sweep(self, keep: int = 2) -> int:
        """Delete versions that none of the last ``keep`` manifests names, and older manifests. Returns how many folders went. Not for a time at which another run writes."""
        numbers = self._manifests()
        kept = [json.loads(self.spark.read.text(f"{self.root}/manifests/{n}", wholetext=True).first().value) for n in numbers[-keep:]]
        named = {v for m in kept for v in m.values() if isinstance(v, str)} | {v for m in kept for v, _ in m.get("docs", {}).values() if v} | {e["path"].rpartition("/")[2] for m in kept for e in m.get("segments") or []}
        swept = 0
        for name in ("docs", "files", "segments", "dead", "vectors", "claims", "reviews"):
            fs, p = self._fs(f"{self.root}/{name}")
            for status in fs.listStatus(p) if fs.exists(p) else []:
                if status.getPath().getName() not in named:
                    swept += bool(fs.delete(status.getPath(), True))
        for n in numbers[:-keep]:
            fs, p = self._fs(f"{self.root}/manifests/{n}")
            fs.delete(p, False)
        return swept

    def remember(self, vault: Path, title: str, body: str, parent: str, private: bool = False, folder: str = "", source: str = "") -> notes.Written:
        """A note in the vault, classified like any document, and the vault's notes read in again, so that the next search finds it."""
        whole = F.lit(f"{title}\n{body}")
        flags = self.spark.range(1).select(self.policy.classify(F.lit(folder), whole).alias("level"), has_secret(whole).alias("secret"), has_email(whole).alias("email")).first()
        written = notes.remember(vault, title, body, parent, flags.level, flags.secret, flags.email, layer="private" if private else "notes", folder=folder, source=source)
        self.ingest("memory", vault.resolve().as_uri())
        return written

    # -- questions

    def search(self, query: str, ranking: str = "fused", encoder: index.Encoder | None = None, **how: object) -> DataFrame:
        """The ranked list, with the ranking that was used in a column of this name: hybrid without vectors or an encoder is fused."""
        if ranking == "hybrid" and not (encoder is not None and self._current("vectors")):
            ranking = "fused"
        found = search.search(self.index(vectors=ranking == "hybrid"), query, ranking=ranking, encoder=encoder, **how)
        return found.withColumn("ranking", F.lit(ranking))

    def timeline(self, **how: object) -> DataFrame:
        return search.timeline(self.docs(), **how)

    def get_doc(self, doc_id: str, **how: object) -> DataFrame:
        return search.get_doc(self.docs(), doc_id, **how)

    def stats(self) -> DataFrame:
        return search.stats(self.docs())

    # -- distilling

    def candidates(self, pending: bool = False, **how: object) -> DataFrame:
        found = distill.select(self.docs(), **how)
        return (distill.pending(found, self.reviews()) if pending else found).orderBy(F.desc("score"), "doc_id")

    def add_claims(self, batch: DataFrame, today: date | None = None) -> None:
        """All claims of the batch and a review of each source, or nothing."""
        everything = tables.cut_lineage(distill.select(self.docs(), min_user_chars=0, min_prose=0.0))
        batch = batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())
        routed = distill.route(batch, self.docs()).where("error is not null").limit(10).collect()
        if routed:
            raise distill.Rejected("; ".join(f"{r.source_doc_id}: {r.error}" for r in routed))
        claims = tables.cut_lineage(distill.add_claims(self.claims(), batch, everything))
        marks = batch.select(F.col("source_doc_id").alias("doc_id")).distinct().select(
            "doc_id", F.lit("").alias("source_fingerprint"), F.lit("claims_extracted").alias("reason"), F.lit(today or date.today()).alias("reviewed_on"), F.lit("").alias("note"), F.lit(1).cast("bigint").alias("seq")
        )
        reviews = tables.cut_lineage(distill.add_reviews(self.reviews(), marks, everything, claims))
        self._publish({
            "claims": self._table(claims.select(*schema.columns(schema.CLAIM)).orderBy("topic", "key", "source_doc_id")),
            "reviews": self._table(reviews.select(*schema.columns(schema.REVIEW)).orderBy("doc_id")),
        })

    def add_reviews(self, batch: DataFrame) -> None:
        everything = distill.select(self.docs(), min_user_chars=0, min_prose=0.0)
        batch = batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())
        reviews = tables.cut_lineage(distill.add_reviews(self.reviews(), batch, everything, self.claims()))
        self._publish({"reviews": self._table(reviews.select(*schema.columns(schema.REVIEW)).orderBy("doc_id"))})

    def leak_gate(self, vault: str) -> DataFrame:
        """(subject, reason): whatever would leak from documents, the vault's notes or the claims; no row if nothing does."""
        docs = self.docs()
        listed = self.policy.apply_overrides(docs).where(F.col("sensitivity") == NDA).select("doc_id").join(docs.where(F.col("sensitivity") != NDA).select("doc_id"), "doc_id", "left_semi")
        found = distill.leaks(docs, self.policy).select(F.col("doc_id").alias("subject"), "reason").unionByName(listed.select(F.col("doc_id").alias("subject"), F.lit("listed as confidential").alias("reason")))
        kept = note_files(self.spark, vault)
        return found.unionByName(distill.layer_leaks(kept, docs, self.policy)).unionByName(distill.store_leaks(self.claims(), docs, self.policy))

    def progress(self) -> DataFrame:
        return distill.progress(distill.select(self.docs()), self.claims(), self.reviews())
