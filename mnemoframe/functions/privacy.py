"""Which text is confidential, and what must be removed from any."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Example projects and names that make a text confidential; real lists are given to Policy.
DENY_SLUGS = ("acme-poc", "CRM-globex", "CRM_globex", "interviewkit", "Teamco-Website", "ini-tech", "Umbrella-Energie", "hooli-mag-website", "Globex-GmbH", "final-pr-acme", "acme-tooling")
DENY_TERMS = ("acme", "globex", "docparse", "interviewkit", "storybot", "ini.tech", "ini-tech", "ini tech", "Umbrella Energie", "Umbrella-Energie", "hooli mag", "hooli-mag", "Teamco Website", "Teamco-Website")
#: Forms of addresses (not of images named @2x.) and of keys and tokens.
EMAIL = r"(?i)[A-Z0-9._%+~-]+@(?![0-9]x\.)[A-Z0-9.-]+\.[A-Z]{2,}"
SECRET = "|".join((
    r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"an_sk_[A-Za-z0-9_-]{20,}",
    r"sk_(?:live|test)_[A-Za-z0-9]{16,}",
    r"xox[abpr]-[A-Za-z0-9-]{10,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"(?i:[A-Z0-9_]*(?:API_?KEY|SECRET|TOKEN|PASSWORD|PASSWD))\b[\"']?\s*[=:]\s*[\"']?(?=[A-Za-z0-9_\-./+]*\d)(?=[A-Za-z0-9_\-./+]*[A-Za-z])[A-Za-z0-9_\-./+]{24,}",
))
#: Each form of a key holds one of these.
HINT = r"(?i)sk[-_]|github_pat_|gh[pousr]_|akia|aiza|xox|glpat|private|key|secret|token|passw"
REDACTED = "[secret removed]"
CLEAN, COPYRIGHT, NDA = "clean", "copyright", "nda"


def _literal(term: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", term)


@dataclass(frozen=True)
class Policy:
    """What is confidential: parts of project names, names in texts, and single conversations (source, conv_id)."""

    deny_slugs: Sequence[str] = DENY_SLUGS
    deny_terms: Sequence[str] = DENY_TERMS
    overrides: frozenset[tuple[str, str]] = field(default_factory=frozenset)

    @property
    def signature(self) -> str:
        """Changes with anything that may change a classification."""
        rows = [*self.deny_slugs, "--terms--", *self.deny_terms, EMAIL, SECRET, "--overrides--", *("\0".join(o) for o in sorted(self.overrides))]
        return hashlib.sha256("\0".join(rows).encode()).hexdigest()[:16]

    def slug_denied(self, project: Column) -> Column:
        low = F.lower(project)
        return F.coalesce(F.greatest(F.lit(False), *[F.contains(low, F.lit(s.lower())) for s in self.deny_slugs]), F.lit(False))

    def term_denied(self, text: Column) -> Column:
        if not self.deny_terms:
            return F.lit(False)
        return text.rlike(r"(?iU)\b(?:" + "|".join(map(_literal, self.deny_terms)) + r")\b")

    def classify(self, project: Column, text: Column) -> Column:
        """nda by project, name, address or secret; else clean. A null text counts as empty."""
        both = F.concat(F.coalesce(project, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
        hit = self.slug_denied(project) | self.term_denied(both) | has_email(both) | has_secret(both)
        return F.when(hit, F.lit(NDA)).otherwise(F.lit(CLEAN))

    def apply_overrides(self, docs: DataFrame) -> DataFrame:
        """``docs`` (source, conv_id, sensitivity) with the listed conversations set to nda. The list is bounded by the policy."""
        if not self.overrides:
            return docs
        listed = docs.sparkSession.createDataFrame(sorted(self.overrides), "source string, conv_id string").withColumn("_denied", F.lit(True))
        joined = docs.join(F.broadcast(listed), ["source", "conv_id"], "left")
        return joined.withColumn("sensitivity", F.when(F.col("_denied"), F.lit(NDA)).otherwise(F.col("sensitivity"))).select(*docs.columns)


def read_overrides(payload: object, known_sources: Sequence[str], required: bool = True) -> frozenset[tuple[str, str]]:
    """The checked contents of an overrides file; anything out of shape is an error, so that nothing opens by accident."""
    if not isinstance(payload, dict) or payload.get("version") != 1 or not isinstance(payload.get("sources"), list):
        raise ValueError("overrides need version 1 and a list of sources")
    found = set()
    for row in payload["sources"]:
        pair = tuple(str(row.get(k) or "").strip() if isinstance(row, dict) and isinstance(row.get(k), str) else "" for k in ("source", "conv_id"))
        if not all(pair) or pair[0] not in known_sources:
            raise ValueError(f"not an override: {row!r}")
        found.add(pair)
    if required and not found:
        raise ValueError("overrides are empty")
    return frozenset(found)


def has_email(c: Column) -> Column:
    """One character before the @ tells as much as all of them, which would be tried from each place of a long run. Most texts have no @ at all."""
    return F.contains(c, F.lit("@")) & c.rlike(EMAIL.replace("-]+@", "-]@", 1))


def has_secret(c: Column) -> Column:
    """Texts without any of the hints are left alone; for whether there is one, the name before a key word doesn't matter."""
    return c.rlike(HINT) & c.rlike(SECRET.replace("(?i:[A-Z0-9_]*", "(?i:"))


def redact_secrets(c: Column) -> Column:
    return F.when(has_secret(c), F.regexp_replace(c, SECRET, REDACTED)).otherwise(c)


def redact_docs(docs: DataFrame) -> DataFrame:
    """Secrets out of titles, turns and metadata. Classify first: what is removed is what marks a text."""
    turns = F.transform("turns", lambda t: t.withField("text", redact_secrets(t["text"])))
    flat = {c: redact_secrets(F.col(c)) for c in ("title", "project", "cwd", "git_branch") if c in docs.columns}
    return docs.withColumns({**flat, "turns": turns})


def visible(docs: DataFrame, include_nda: bool = False, source: str | None = None, project: str | None = None, since: object = None) -> DataFrame:
    """The one filter of all readers. A document without a day is never since a day; an unknown sensitivity is hidden."""
    if not include_nda:
        docs = docs.where(F.col("sensitivity").isin(CLEAN, COPYRIGHT))
    if source:
        docs = docs.where(F.col("source") == source)
    if project:
        docs = docs.where(F.contains(F.lower("project"), F.lit(project.lower())))
    if since is not None:
        docs = docs.where(F.col("started_day") >= F.lit(since).cast("date"))
    return docs
