"""Where agent memory files go, and whether the private layer is indexed."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import privacy
from mnemoframe.operators import notes

SKELETON = {"BRAIN": "# Brain\n\n- [[notes/profile]]\n- [[notes/projects]]\n- [[notes/knowledge]]\n- [[private/INDEX]]\n", "notes/profile": "# Profile\n", "notes/projects": "# Projects\n", "notes/knowledge": "# Knowledge\n", "private/INDEX": "# Private\n"}


def loose_terms(text: Column, terms: Sequence[str] = privacy.DENY_TERMS) -> Column:
    """Denied names as plain substrings: broader than the classifier's whole words, for what is about to be copied."""
    low = F.lower(text)
    return F.coalesce(F.greatest(F.lit(False), *[F.contains(low, F.lit(t.lower())) for t in terms]), F.lit(False))


def route_memory(files: DataFrame, projects: DataFrame, private_now: DataFrame, policy: privacy.Policy | None = None) -> DataFrame:
    """``files`` (path, project, text) with layer: clean, private or refused.

    A secret is refused. A file that is private already stays so; a project that isn't listed, or whose name or text is
    confidential, is private. projects: (project); private_now: (path).
    """
    policy = policy or privacy.Policy()
    rows = files.join(projects.select("project").distinct().withColumn("_known", F.lit(True)), "project", "left")
    rows = rows.join(private_now.select("path").distinct().withColumn("_private", F.lit(True)), "path", "left")
    body = F.coalesce(F.col("text"), F.lit(""))
    private = F.col("_private").isNotNull() | F.col("_known").isNull() | policy.slug_denied(F.col("project")) | loose_terms(body, policy.deny_terms) | privacy.has_email(body)
    layer = F.when(privacy.has_secret(body), F.lit("refused")).when(private, F.lit("private")).otherwise(F.lit("clean"))
    return rows.select(*files.columns, layer.alias("layer"))


def unindexed_private(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Private files (path) without a document: what the index would miss."""
    return files.join(docs.where("source = 'memory'").select(F.col("conv_id").alias("path")), "path", "left_anti")


def init_vault(root: Path) -> list[Path]:
    """The skeleton of a vault. What is there already is never touched."""
    made = []
    for node, body in SKELETON.items():
        path = root / f"{node}.md"
        if not path.exists():
            head = "" if node == notes.ROOT else f'---\nparent: "[[{notes.ROOT}]]"\n---\n'
            notes.replace_file(path, head + body)
            made.append(path)
    return made
