"""Changes that keep several tables in step: cascades, upserts, sessions, memories, plan moves (DML, DED, GRF-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T


def newer_or_old(old: Column, new: Column, empty: str | None = "") -> Column:
    """The new value unless it is null or `empty`, else the old one."""
    return F.coalesce(F.nullif(new, F.lit(empty)) if empty is not None else new, old)


def upserted(table: DataFrame, new: DataFrame, key: list[str], changed: dict[str, Column]) -> DataFrame:
    """`table` with the rows of `new` added, or where the key is there, its columns set as `changed` says in terms of the old ones and of new ones named new_ (DML-02, ON CONFLICT DO UPDATE)."""
    columns = [c for c in table.columns if c not in key]
    right = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_there"))
    met = table.withColumn("_old", F.lit(True)).join(right, key, "full_outer")
    value = lambda c: F.when(F.col("_old") & F.col("_there"), changed.get(c, F.col(c))).when(F.col("_old"), F.col(c)).otherwise(F.col(f"new_{c}"))
    return met.select(*key, *[value(c).alias(c) for c in columns]).select(*table.columns)


def inserted_or_ignored(table: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """`table` and those rows of `new` whose key is not there; of several with one key the first (DML-02, INSERT OR IGNORE)."""
    fresh = new.join(table.select(*key), key, "left_anti").groupBy(*key).agg(F.min_by(F.struct(*table.columns), order).alias("r")).select("r.*")
    return table.unionByName(fresh)


def inserted_or_replaced(table: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """`table` with the last row of `new` for each key in place of its own (DML-02, INSERT OR REPLACE)."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*table.columns), order).alias("r")).select("r.*")
    return table.join(last.select(*key), key, "left_anti").unionByName(last)


def paper_upsert(papers: DataFrame, parsed: DataFrame) -> DataFrame:
    """Papers after an index pass (DED-08): a title with a recorded original stays, other values are replaced by non-empty new ones, the source file always."""
    keep = F.coalesce(F.col("title_original"), F.lit("")) != ""
    changed = {"title": F.when(keep, F.col("title")).otherwise(F.col("new_title")), "title_original": F.col("title_original"), "year": F.coalesce("new_year", "year"), "source_pdf": F.col("new_source_pdf")}
    changed |= {c: newer_or_old(F.col(c), F.col(f"new_{c}")) for c in papers.columns if c not in (*changed, "paper_id")}
    return upserted(papers, parsed.select(*[F.col(c) if c in parsed.columns else F.lit(None).cast("string").alias(c) for c in papers.columns]), ["paper_id"], changed)


def catalog_sync(catalog: DataFrame, papers: DataFrame, force: bool = False) -> DataFrame:
    """The catalog (citation_key, paper_id, title, authors, year, doi, aliases) after a sync with the papers (DED-07).

    Nothing is done, unless forced, where the catalog has as many papers and no title differs. Else non-empty values overwrite, a null year
    doesn't, and new papers get keys that nobody has and their id and title as aliases.
    """
    kept = catalog.filter("paper_id is not null")
    differs = kept.join(papers.select("paper_id", F.col("title").alias("t")), "paper_id").filter(F.coalesce("title", F.lit("")) != F.coalesce("t", F.lit("")))
    if not force and kept.count() >= papers.count() and differs.isEmpty():
        return catalog
    right = papers.select("paper_id", F.col("title").alias("new_title"), F.col("authors").alias("new_authors"), F.col("year").alias("new_year"), T.doi_key("doi").alias("new_doi"))
    met = catalog.join(right, "paper_id", "left")
    old = met.select("citation_key", "paper_id", *[newer_or_old(F.col(c), F.col(f"new_{c}")).alias(c) for c in ("title", "authors")], F.coalesce("new_year", "year").alias("year"), newer_or_old(F.col("doi"), F.col("new_doi")).alias("doi"), "aliases")
    fresh = papers.join(kept.select("paper_id"), "paper_id", "left_anti")
    titled = fresh.withColumn("base", T.citation_key("authors", "year", F.coalesce(F.nullif("title", F.lit("")), "paper_id")))
    alias = F.when(F.coalesce(F.nullif("title", F.lit("")), "paper_id") != F.col("paper_id"), F.array("paper_id", "title")).otherwise(F.array("paper_id"))
    new = unique_keys(titled, catalog, "base", "paper_id").select("citation_key", "paper_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.lit("")).alias("authors"), "year", T.doi_key("doi").alias("doi"), alias.alias("aliases"))
    return old.unionByName(new)


def unique_keys(rows: DataFrame, taken: DataFrame, base: str, order: str) -> DataFrame:
    """Adds citation_key: the base key, or the base with the least number from 2 that neither `taken` (citation_key) nor an earlier row has (STR-12).

    Used numbers of a base are one array, which is as long as keys collide; the n-th new row of a base takes the n-th free number.
    """
    used = taken.select(F.regexp_extract("citation_key", r"^(.*?)(\d*)$", 1).alias("stem"), "citation_key")
    own = rows.select(base).distinct().withColumn("stem", F.regexp_extract(base, r"^(.*?)(\d*)$", 1))
    numbers = own.join(used, "stem").filter(F.startswith(F.col("citation_key"), F.col(base))).withColumn("rest", F.substr("citation_key", F.char_length(base) + 1)).filter(F.col("rest").rlike(r"^([2-9]|[1-9]\d{1,6})?$"))
    held = numbers.groupBy(base).agg(F.collect_set(F.when(F.col("rest") == "", 1).otherwise(F.col("rest").cast("int"))).alias("held"))
    nth = F.row_number().over(Window.partitionBy(base).orderBy(order))
    met = rows.withColumn("_n", nth).join(held, base, "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
    free = F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("_n") + F.size("held")), F.col("held")))
    met = met.withColumn("_k", F.get(free, F.col("_n") - 1))
    return met.withColumn("citation_key", F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat(base, F.col("_k").cast("string")))).drop("_n", "_k", "held")


def applied_imports(catalog: DataFrame, matches: DataFrame, include_review: bool = False) -> DataFrame:
    """The catalog (citation_key, paper_id, title, authors, year, doi, journal, aliases) after an import batch (DED-06).

    matches: row, status, paper_id, proposed_key and the record's external_key, title, authors, year, doi, journal. Matched rows, and with `include_review` those for review,
    fill a paper's empty fields, the earliest row first, and add their key to its aliases; rows without a paper become entries of their own.
    """
    allowed = matches.filter(F.col("status").isin("matched", "review") if include_review else F.col("status") == "matched")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("row"))).alias(f"new_{c}")
    doi = allowed.withColumn("doi", T.doi_key("doi"))
    filled = doi.filter("paper_id is not null").groupBy("paper_id").agg(*[first(c) for c in ("authors", "year", "doi", "journal")], F.array_sort(F.collect_list(F.when(F.coalesce("external_key", F.lit("")) != "", F.struct("row", "external_key")))).alias("x"))
    met = catalog.join(filled, "paper_id", "left")
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"new_{c}")).alias(c)
    alias = F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(F.transform("x", lambda e: e["external_key"]), F.array().cast("array<string>"))))
    old = met.select("citation_key", "paper_id", "title", fill("authors"), F.coalesce("year", "new_year").alias("year"), fill("doi"), fill("journal"), alias.alias("aliases"))
    new = unique_keys(doi.filter("paper_id is null").withColumnRenamed("proposed_key", "base"), catalog, "base", "row")
    added = new.select("citation_key", F.lit(None).cast("string").alias("paper_id"), "title", "authors", "year", "doi", "journal", F.array("external_key").alias("aliases"))
    return old.unionByName(added)


def without_papers(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table of rows with a paper_id without the rows of the papers `gone` (paper_id) (DED-14)."""
    return {name: rows.join(gone.select("paper_id"), "paper_id", "left_anti") for name, rows in tables.items()}


def graph_without_papers(entities: DataFrame, relations: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (entity_id, paper_ids, chunk_count), relations and links (entity_id, chunk_id, paper_id) without some papers (GRF-08).

    Their links and relations go; entities lose the papers and as many chunks as were linked, not below zero; an entity without papers goes,
    and with it what still refers to it.
    """
    lost = links.join(gone, "paper_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("lost"))
    listed = entities.select("entity_id", F.posexplode("paper_ids").alias("_i", "paper_id")).join(gone.select("paper_id").distinct().withColumn("_gone", F.lit(True)), "paper_id", "left")
    staying = F.array_sort(F.collect_list(F.when(F.col("_gone").isNull(), F.struct("_i", "paper_id"))))
    touched = listed.groupBy("entity_id").agg(F.transform(staying, lambda x: x["paper_id"]).alias("_left"), F.max("_gone").alias("_t")).filter("_t").drop("_t")
    met = entities.join(touched, "entity_id", "left").join(lost, "entity_id", "left")
    count = F.when(F.col("_left").isNotNull(), F.greatest(F.lit(0), F.col("chunk_count") - F.coalesce("lost", F.lit(0)))).otherwise(F.col("chunk_count"))
    kept = met.filter("_left is null or size(_left) > 0").select("entity_id", F.coalesce("_left", "paper_ids").alias("paper_ids"), count.cast("long").alias("chunk_count"))
    there = kept.select("entity_id")
    ends = lambda rows, c: rows.join(there.withColumnRenamed("entity_id", c), c, "left_semi")
    return kept, ends(ends(relations.join(gone, "paper_id", "left_anti"), "source_id"), "target_id").select(*relations.columns), links.join(gone, "paper_id", "left_anti").join(there, "entity_id", "left_semi").select(*links.columns)


def deleted_unless_used(rows: DataFrame, asked: DataFrame, key: str, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, answers): rows of the keys asked for go, except those that `users` refer to; answers are (key, status, used) (DML-05)."""
    used = users.groupBy(key).agg(F.count(F.lit(1)).alias("used"))
    known = asked.join(rows.select(key).withColumn("_there", F.lit(True)), key, "left").join(used, key, "left")
    status = F.when(F.col("_there").isNull(), "not found").when(F.coalesce("used", F.lit(0)) > 0, "refused").otherwise("deleted")
    answers = known.select(key, status.alias("status"), F.coalesce("used", F.lit(0)).alias("used"))
    return rows.join(answers.filter("status = 'deleted'"), key, "left_anti"), answers


def turns_appended(sessions: DataFrame, turns: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions (session_id, updated_at, turn_count) and turns (session_id, turn_index, content) after `new` ones (session_id, content, created_at), numbered on from each session's last (DML-09, WIN-05)."""
    last = turns.groupBy("session_id").agg((F.max("turn_index") + 1).alias("next"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "content")) - 1
    added = new.join(last, "session_id", "left").select("session_id", (F.coalesce("next", F.lit(0)) + place).cast("long").alias("turn_index"), "content", "created_at")
    sums = added.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("at"))
    changed = sessions.join(sums, "session_id", "left").select("session_id", F.coalesce("at", "updated_at").alias("updated_at"), (F.col("turn_count") + F.coalesce("n", F.lit(0))).alias("turn_count"))
    return changed, turns.unionByName(added.select(*turns.columns))


def clip_chunks(chunks: DataFrame, clips: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunks (chunk_id, paper_id, section_name, page_start, page_end, position, text) with saved clips (clip_id, paper_id, page, text) of known papers as chunks behind all others (DML-10); a blank clip is none."""
    said = clips.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''").join(papers.select("paper_id"), "paper_id", "left_semi")
    new = said.select(F.concat(F.lit("clip_"), "clip_id").alias("chunk_id"), "paper_id", F.lit("Saved highlight").alias("section_name"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.lit(1_000_000).cast("long").alias("position"), "text")
    return chunks.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


# fixed values: columns of the board
TASK_COLUMN = {"todo": "todo", "in_progress": "doing", "done": "done"}
RUN_COLUMN = {"planned": "todo", "in_progress": "doing", "done": "done", "failed": "done", "abandoned": "done"}
TASK_STATUS = {"todo": "todo", "doing": "in_progress", "done": "done"}
RUN_STATUS = {"todo": "planned", "doing": "in_progress", "done": "done"}


def _of(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def run_date() -> Column:
    """The day of an experiment (status, ran_on, scheduled_for): when it ran, once it has started, else when it is scheduled (DAT-05)."""
    return F.when((F.col("status") != "planned") & F.col("ran_on").isNotNull(), F.col("ran_on")).otherwise(F.coalesce("scheduled_for", "ran_on"))


def plan_items(experiments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Experiments (id, name, status, scheduled_for, ran_on) and tasks (id, title, status, due_date, experiment_id) as items of one shape: kind, id, title, date, status, column, closed, task_count, open_tasks (DML-07)."""
    counts = tasks.filter("experiment_id is not null").groupBy(F.col("experiment_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "done").alias("open"))
    runs = experiments.join(counts, "id", "left").select(F.lit("experiment").alias("kind"), "id", F.col("name").alias("title"), run_date().alias("date"), "status", F.coalesce(_of(RUN_COLUMN, F.col("status")), F.lit("todo")).alias("column"), F.col("status").isin("done", "failed", "abandoned").alias("closed"), F.coalesce("n", F.lit(0)).alias("task_count"), F.coalesce("open", F.lit(0)).alias("open_tasks"))
    none = F.lit(None).cast("long")
    return runs.unionByName(tasks.select(F.lit("task").alias("kind"), "id", "title", F.col("due_date").alias("date"), "status", F.coalesce(_of(TASK_COLUMN, F.col("status")), F.lit("todo")).alias("column"), (F.col("status") == "done").alias("closed"), none.alias("task_count"), none.alias("open_tasks")))


def moved_tasks(tasks: DataFrame, moves: DataFrame, now: Column) -> DataFrame:
    """Tasks (id, due_date, status, completed_at, ...) after moves (id, dated, date, column): a move with `dated` sets the day, one with a column the status; done sets completed_at once, anything else clears it (DML-08)."""
    met = tasks.join(moves.select("id", "dated", "date", F.col("column").alias("_column")), "id", "left")
    status = _of(TASK_STATUS, F.col("_column"))
    done = F.when(status.isNull() | ((status == "done") & (F.col("status") == "done")), F.col("completed_at")).when(status == "done", now)
    return met.select(*[{"due_date": F.when(F.col("dated"), F.col("date")).otherwise(F.col("due_date")), "status": F.coalesce(status, "status"), "completed_at": done}.get(c, F.col(c)).alias(c) for c in tasks.columns])


def moved_experiments(experiments: DataFrame, tasks: DataFrame, moves: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Experiments (id, status, scheduled_for, ran_on) after moves (id, dated, date, column), and tasks of which the open ones with a day travel with their experiment (DML-08, DAT-04).

    A started run moves its run day, a planned one its schedule. Done doesn't overwrite failed or abandoned. Starting or finishing records when: the
    scheduled day, or today if that lies ahead or is unknown.
    """
    met = experiments.join(moves.select("id", "dated", "date", F.col("column").alias("_column")), "id", "left").withColumn("old_day", run_date())
    started = (F.col("status") != "planned") & F.col("ran_on").isNotNull()
    dated = F.coalesce("dated", F.lit(False))
    ran = F.when(dated & started, F.col("date")).otherwise(F.col("ran_on"))
    planned = F.when(dated & ~started, F.col("date")).otherwise(F.col("scheduled_for"))
    target = _of(RUN_STATUS, F.col("_column"))
    status = F.when(target.isNull() | ((target == "done") & F.col("status").isin("failed", "abandoned")), F.col("status")).otherwise(target)
    set_ = met.withColumn("_s", planned).withColumn("_r", ran).withColumn("_status", status)
    begun = F.col("_column").isNotNull() & F.col("_status").isin("in_progress", "done") & F.col("_r").isNull()
    recorded = F.when(begun, F.when(F.col("_s") <= today, F.col("_s")).otherwise(today)).otherwise(F.col("_r"))
    out = set_.select("id", F.col("_status").alias("status"), F.col("_s").alias("scheduled_for"), recorded.alias("ran_on"), F.when(dated & F.col("date").isNotNull(), F.datediff("date", "old_day")).alias("_shift"))
    shift = out.select(F.col("id").alias("experiment_id"), "_shift").filter("_shift <> 0")
    moved = tasks.join(shift, "experiment_id", "left").withColumn("due_date", F.when((F.col("status") != "done") & F.col("_shift").isNotNull(), F.date_add("due_date", F.col("_shift"))).otherwise(F.col("due_date")))
    return out.drop("_shift"), moved.select(*tasks.columns)


def repaired_paths(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Papers (paper_id, source_pdf) whose path is that of a file (path), else of the first file of the same name, with the state ok, fixed or missing (DED-11)."""
    name = lambda c: F.regexp_replace(c, "^.*/", "")
    named = files.groupBy(name("path").alias("name")).agg(F.min("path").alias("moved"))
    met = papers.withColumn("name", name("source_pdf")).join(files.select(F.col("path").alias("source_pdf"), F.lit(True).alias("there")).distinct(), "source_pdf", "left").join(named, "name", "left")
    path = F.when(F.col("there"), F.col("source_pdf")).otherwise(F.col("moved"))
    return met.select("paper_id", F.coalesce(path, "source_pdf").alias("source_pdf"), F.when(path.isNull(), "missing").when(path == F.col("source_pdf"), "ok").otherwise("fixed").alias("state"))


def garbled_repaired(chunks: DataFrame, again: DataFrame) -> DataFrame:
    """Chunks (paper_id, chunk_id, text) in which garbled papers' rows are replaced by those of a second reading, with `repaired` (DED-13)."""
    bad = chunks.groupBy("paper_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), " ").alias("text")).filter(T.is_garbled("text")).select("paper_id")
    kept = chunks.join(bad, "paper_id", "left_anti").withColumn("repaired", F.lit(False))
    return kept.unionByName(again.join(bad, "paper_id", "left_semi").withColumn("repaired", F.lit(True)))


def memories_saved(new: DataFrame, embed) -> dict[str, DataFrame]:  # noqa: ANN001
    """The three stores of memories (memory_id, content, created_at): rows, words and vectors (DML-14)."""
    from scholiast.functions.models import embedded

    words = new.select("memory_id", F.explode(T.tokens("content")).alias("token")).groupBy("token", "memory_id").agg(F.count(F.lit(1)).alias("tf"))
    return {"memories": new, "words": words, "vectors": embedded(new.select("memory_id", "content"), "content", embed).drop("content")}


def memories_deleted(stores: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All stores without the memories `gone` (memory_id)."""
    return {name: rows.join(gone, "memory_id", "left_anti") for name, rows in stores.items()}


def memories_listed(memories: DataFrame, limit: int = 200) -> DataFrame:
    """The newest memories with their place."""
    newest = memories.orderBy(F.desc("created_at"), "memory_id").limit(limit)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "memory_id")))


def folders_without(folders: DataFrame, notes: DataFrame, gone: str) -> tuple[DataFrame, DataFrame]:
    """Folders without one of them, and notes of which that one's are filed nowhere (DML-15)."""
    return folders.filter(F.col("folder") != gone), notes.withColumn("folder", F.when(F.col("folder") != gone, F.col("folder")))


def capped(files: DataFrame, text: str, most: int) -> DataFrame:
    """Files whose texts have at most `most` characters (DML-16)."""
    return files.withColumn(text, F.left(text, F.lit(most)))


def reordered(files: DataFrame, order: DataFrame) -> DataFrame:
    """Files (project, slug, sort_order) of each project in the new `order` (project, slug, sort_order), if that names exactly its slugs, each once; else as they were (DML-16)."""
    met = files.select("project", "slug", F.lit(1).alias("there")).join(order.groupBy("project", "slug").agg(F.count(F.lit(1)).alias("named")), ["project", "slug"], "full_outer")
    wrong = met.filter("there is null or named is null or named > 1").select("project").distinct().withColumn("_wrong", F.lit(True))
    new = order.select("project", "slug", F.col("sort_order").alias("_order")).dropDuplicates(["project", "slug"])
    out = files.join(wrong, "project", "left").join(new, ["project", "slug"], "left")
    return out.withColumn("sort_order", F.when(F.col("_wrong"), F.col("sort_order")).otherwise(F.coalesce("_order", "sort_order"))).drop("_wrong", "_order")


# fixed values: kinds of mark on a page
MARK_TYPES = ["highlight", "underline", "note", "box"]


def reviewed(marks: DataFrame, cleared: DataFrame) -> DataFrame:
    """Marks (paper, id, type, color, created_at) of a known type with a colour #rrggbb, without those of cleared papers (DML-17)."""
    return marks.filter(F.col("type").isin(MARK_TYPES) & F.col("color").rlike(r"^#[0-9a-fA-F]{6}$")).join(cleared, "paper", "left_anti")


def json_list(text: Column) -> Column:
    """The strings of a JSON list; a broken or missing one is empty (JSN-01)."""
    return F.coalesce(F.from_json(F.when(text.rlike(r"^\s*\[.*\]\s*$"), text), "array<string>"), F.array().cast("array<string>"))


def list_with(text: Column, value: Column) -> Column:
    """The list with a value at its end if it is missing (ARR-03)."""
    held = F.array_distinct(json_list(text))
    return F.when(F.array_contains(held, value), held).otherwise(F.array_append(held, value))


def list_without(text: Column, value: Column) -> Column:
    return F.array_remove(json_list(text), value)


def list_holds(text: Column, value: Column) -> Column:
    """Whether a JSON list has a value, of whole elements, not of substrings (ARR-04)."""
    return F.array_contains(json_list(text), value)


def settings(saved: Column | str, defaults: dict[str, str]) -> dict[str, Column]:
    """Every setting as saved in a JSON object, else its default (JSN-02)."""
    known = F.from_json(saved, "map<string,string>")
    return {name: F.coalesce(F.try_element_at(known, F.lit(name)), F.lit(value)) for name, value in defaults.items()}


def instant(text: Column) -> Column:
    """An ISO text as an instant, Z and no offset being UTC; anything else is null (DAT-01)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(text))


def day_of_parts(parts: Column) -> Column:
    """[y], [y, m] or [y, m, d] as yyyy-mm-dd, missing parts being 01 (DAT-02)."""
    two = lambda i: F.lpad(F.coalesce(F.get(parts, F.lit(i)), F.lit(1)).cast("string"), 2, "0")
    return F.when(F.size(parts) > 0, F.concat_ws("-", F.lpad(F.get(parts, F.lit(0)).cast("string"), 4, "0"), two(1), two(2)))


def epoch_seconds(moment: Column) -> Column:
    """Seconds since the epoch as a double (DAT-06)."""
    return F.unix_micros(moment) / F.lit(1e6)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1e6).cast("long"))


def vector_coverage(articles: DataFrame, points: DataFrame) -> DataFrame:
    """(journal_id, articles, points, complete) from articles and points (journal_id): MISSING where a journal has no points (AGG-22)."""
    a = articles.groupBy("journal_id").agg(F.count(F.lit(1)).alias("articles"))
    met = a.join(points.groupBy("journal_id").agg(F.count(F.lit(1)).alias("n")), "journal_id", "left")
    return met.select("journal_id", "articles", F.coalesce(F.col("n").cast("string"), F.lit("MISSING")).alias("points"), (F.coalesce("n", F.lit(0)) == F.col("articles")).alias("complete"))


def integrity(papers: DataFrame, chunks: DataFrame, vectors: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """(name, n): checks of papers (paper_id, title), chunks (chunk_id, paper_id, page_start, text), vectors (chunk_id) and the graph (AGG-21)."""
    checks = {
        "orphan chunks": chunks.join(papers, "paper_id", "left_anti"),
        "chunks": chunks,
        "vectors": vectors,
        "indexed": chunks.filter(F.size(T.tokens("text")) > 0),
        "chunks without vector": chunks.join(vectors, "chunk_id", "left_anti"),
        "junk titles": papers.filter(T.is_junk_title("title")),
        "pages above 1": chunks.filter("page_start > 1"),
        "dangling links": links.join(entities, "entity_id", "left_anti"),
    }
    out = None
    for name, rows in checks.items():
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
