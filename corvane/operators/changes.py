"""What a change touches: changed files, the assets below their folders, those that depend on them; and the runtime catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses that a runtime catalogue admits.
RUNTIME = ("approved", "restricted")


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """path: the lines of a text file that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path != ''")


def touched(changed: DataFrame, assets: DataFrame, name: str, file: str) -> DataFrame:
    """Names of assets (name, path) whose path begins with the first folder of a changed file of this name.

    Every beginning of a path is looked up by equality, so the prefix join is a hash join."""
    folders = changed.filter(F.element_at(F.split("path", "/"), -1) == file).select(F.element_at(F.split("path", "/"), 1).alias("folder")).filter("folder != ''").distinct()
    heads = assets.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda n: F.substr("path", F.lit(1), n))).alias("folder"))
    return heads.join(folders, "folder", "left_semi").select(name).distinct()


def blast_radius(changed: DataFrame, skills: DataFrame, tools: DataFrame) -> DataFrame:
    """skill_name and bundle_scope of skills that changed tools serve, that changed themselves, or that depend on changed ones.

    A dependent skill counts without its bundle."""
    calls = tools.select("tool_name", F.explode("called_by_skills").alias("skill_name")).join(touched(changed, tools, "tool_name", "TOOL.md"), "tool_name", "left_semi")
    own = touched(changed, skills, "skill_name", "SKILL.md")
    direct = calls.select("skill_name").unionByName(own).distinct()
    direct = skills.select("skill_name", "bundle_scope").join(direct, "skill_name", "left_semi")
    after = skills.select("skill_name", F.explode("dependencies").alias("dep")).join(own.withColumnRenamed("skill_name", "dep"), "dep", "left_semi").select("skill_name").distinct()
    after = after.join(direct, "skill_name", "left_anti").select("skill_name", F.lit(None).cast("string").alias("bundle_scope"))
    return direct.unionByName(after)


def runtime_catalog(assets: DataFrame, name: str) -> DataFrame:
    """Each asset with `allowed`; those left out count by their status (draft without one)."""
    status = F.coalesce("status", F.lit("draft"))
    return assets.select(F.coalesce(name, F.lit("<unknown>")).alias("name"), status.alias("status"), status.isin(*RUNTIME).alias("allowed"))


def catalog_summary(assets: DataFrame, name: str) -> DataFrame:
    return runtime_catalog(assets, name).groupBy("allowed", "status").agg(F.count("*").alias("n"))


def impact_report(radius: DataFrame) -> str:
    """The pull request's comment: a table of bundles and the skills that a change touches there."""
    rows = radius.groupBy(F.coalesce("bundle_scope", F.lit("(dependent)")).alias("bundle")).agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("skill_name")), 1, 20), ", ").alias("names")).orderBy("bundle").collect()
    return "\n".join(["| Bundle | Skills | Names |", "|---|---|---|", *(f"| {r.bundle} | {r.n} | {r.names} |" for r in rows)])


def element_type(n_in: Column, n_out: Column, conditional: Column, parallel: Column) -> Column:
    """The element that a step becomes by its edges."""
    return (
        F.when((n_in == 0) & (n_out == 1), "startEvent").when(n_out == 0, "endEvent").when((n_out > 1) & (conditional > 1), "exclusiveGateway")
        .when((n_out > 1) & (parallel > 0), "parallelGateway").otherwise("task")
    )


def element_map(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """step_id and bpmn_type of steps (step_id) with edges (src, dst, condition, parallel)."""
    outs = edges.groupBy(F.col("src").alias("step_id")).agg(F.count("*").alias("n_out"), F.count("condition").alias("conditional"), F.count_if("parallel").alias("parallel"))
    ins = edges.groupBy(F.col("dst").alias("step_id")).agg(F.count("*").alias("n_in"))
    x = steps.select("step_id").join(outs, "step_id", "left").join(ins, "step_id", "left").na.fill(0)
    return x.select("step_id", element_type(F.col("n_in"), F.col("n_out"), F.col("conditional"), F.col("parallel")).alias("bpmn_type"))


def task_type(actor: Column) -> Column:
    """human, system and automated actors; manual without one."""
    return F.when(actor == "human", "userTask").when(actor == "system", "serviceTask").when(actor == "automated", "scriptTask").otherwise("manualTask")


def link_references(links: DataFrame) -> DataFrame:
    """doc, anchor and place of the first such link: uri and file links with an anchor text of two characters at least."""
    anchor = F.trim(F.regexp_replace(F.coalesce("anchor_text", F.lit("")), r"\s+", " "))
    x = links.filter(F.trim(F.coalesce("kind", F.lit(""))).isin("uri", "file")).select("doc", anchor.alias("anchor"), "place").filter(F.length("anchor") >= 2)
    return x.groupBy("doc", "anchor").agg(F.min("place").alias("place"))


def pending(inputs: DataFrame, done: DataFrame, key: str, *, overwrite: bool = False) -> DataFrame:
    """Inputs whose output isn't there yet; all with overwrite."""
    return inputs if overwrite else inputs.join(done.select(key).distinct(), key, "left_anti")


def qa_files(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("path").endswith(".metadata.json"))


def count_delta(sources: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Groups where fewer documents came out than files went in, with the difference."""
    a, b = sources.groupBy(key).agg(F.count("*").alias("n_source")), merged.groupBy(key).agg(F.count("*").alias("n_merged"))
    x = a.join(b, key, "left").na.fill(0, ["n_merged"]).withColumn("delta", F.col("n_source") - F.col("n_merged"))
    return x.filter("delta > 0")


def latest(records: DataFrame, device: str, order: str, session: str | None = None, wanted: Column | None = None) -> DataFrame:
    """One record per device: the one asked for, or else the newest."""
    if wanted is not None and session is not None:
        return records.filter(F.col(session) == wanted)
    return records.groupBy(device).agg(F.max_by(F.struct(*records.columns), F.struct(order, *[c for c in records.columns if c != order])).alias("r")).select("r.*")


def peers(files: DataFrame) -> DataFrame:
    """Files (path, content) with their SHA-256 and whether another file has the very same bytes."""
    x = files.select("path", F.sha2("content", 256).alias("checksum"))
    n = x.groupBy("checksum").agg(F.count("*").alias("n"))
    return x.join(n, "checksum").select("path", "checksum", (F.col("n") > 1).alias("has_peer"))


def chunk_header(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, chunk and character counts, and the layer of the document (normative without one)."""
    g = chunks.groupBy("doc").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))
    return g.join(documents.select("doc", "layer"), "doc", "left").select("doc", "n_chunks", "n_chars", F.coalesce("layer", F.lit("normative")).alias("layer"))


def spoken_segments(text: Column, most: int = 100) -> Column:
    """Pieces of at most `most` characters, cut at spaces where there are any."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)\S.{{0,{most - 2}}}(?=\s|\z)|\S.{{0,{most - 1}}}"), F.lit(0)), F.trim), lambda s: s != "")
