"""Notes whose paths are gone: candidates, new homes, rewriting, seeding and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import paths as P
from veritrail.functions import text as T
from veritrail.operators import retrieve

#: Where a moved file is looked for, how many folders deep below one of these, and folders that are passed over.
ROOTS, DEPTH = ("/home", "/srv", "/opt", "/data"), 8
PASSED = ("node_modules", ".git", ".build", ".venv", "venv", "Pods", "DerivedData")


def notes(nodes: DataFrame) -> DataFrame:
    """(id_hex, title, body): one row per live record; repeated rows differ in access data only."""
    live = nodes.filter("state = 0 and id is not null")
    return live.groupBy(F.lower(F.hex("id")).alias("id_hex")).agg(F.min("title").alias("title"), F.min("body").alias("body"))


def live_paths(paths: DataFrame) -> DataFrame:
    """(path): the paths whose row of the highest generation is present."""
    return paths.groupBy("path").agg(F.max_by("state", "generation").alias("state")).filter("state = 'present'").select("path")


def mentions(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(id_hex, pos, path, alive): the paths that a note's body names (its title, where the body is null or empty), in order, and whether they are present."""
    return retrieve.anchors(notes(nodes), live_paths(paths), ["id_hex"], F.coalesce(F.nullif(F.col("body"), F.lit("")), F.col("title")))


def candidates(mentioned: DataFrame) -> DataFrame:
    """(id_hex, dead, first_dead): notes with dead paths and no live one, with the first of them."""
    dead = ~F.col("alive")
    g = mentioned.groupBy("id_hex").agg(F.count_if(dead).alias("dead"), F.max("alive").alias("some"), F.min_by("path", F.struct("alive", "pos")).alias("first_dead"))
    return g.filter("dead > 0 and not some").select("id_hex", "dead", "first_dead")


def searched(path: Column, roots: tuple[str, ...] = ROOTS, depth: int = DEPTH) -> Column:
    """Whether a moved file is looked for here: below a root, not too deep, in no folder that is passed over."""
    below = F.lit(False)
    for r in roots:
        below = below | (F.startswith(path, F.lit(f"{r}/")) & (F.size(F.split(path, "/")) - r.count("/") - 1 <= depth))
    return below & ~path.rlike("/(" + "|".join(x.replace(".", r"\.") for x in PASSED) + ")/")


def homes(paths: DataFrame, roots: tuple[str, ...] = ROOTS, depth: int = DEPTH) -> DataFrame:
    """(name, n, files, at): how many present files and folders have a name, how many of them are files, and the smallest such path."""
    now = live_paths(paths)
    parts = F.split("path", "/")
    above = now.select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct()
    both = now.withColumn("file", F.lit(1)).unionByName(above.withColumn("file", F.lit(0))).filter(searched(F.col("path"), roots, depth))
    return both.groupBy(P.basename(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.sum("file").alias("files"), F.min("path").alias("at"))


def outcomes(mentioned: DataFrame, paths: DataFrame, roots: tuple[str, ...] = ROOTS, depth: int = DEPTH) -> DataFrame:
    """(id_hex, path, outcome, new_path), one row per stale note, by its first dead path.

    REBUILT if exactly one present path has its name and that is a file, AMBIGUOUS if several have, else NOTFOUND.
    """
    dead = candidates(mentioned).select("id_hex", F.col("first_dead").alias("path")).withColumn("name", P.basename(F.col("path")))
    met = dead.join(homes(paths, roots, depth), "name", "left")
    sole = (F.col("n") == 1) & (F.col("files") == 1)
    out = F.when(sole, "REBUILT").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NOTFOUND")
    return met.select("id_hex", "path", out.alias("outcome"), F.when(sole, F.col("at")).alias("new_path"))


def rewritten(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id_hex, title, body): the rebuilt notes after the change; in the title the form below the home folder is replaced first, then the whole path."""
    n = notes(nodes).join(found.filter("outcome = 'REBUILT'").select("id_hex", F.col("path").alias("old"), F.col("new_path").alias("new")), "id_hex")
    old, new = F.col("old"), F.col("new")
    title = P.rewrite_path(P.rewrite_path(F.col("title"), P.home_relative(old), P.home_relative(new)), old, new)
    return n.select("id_hex", title.alias("title"), P.rewrite_path(F.col("body"), old, new).alias("body"))


def replaced_edits(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id_hex, rebuilt_hex): edit notes, titled `<path below home> — edited ...`, that a note rebuilt at this path replaces; of several the smallest. Blanks, % and _ in a path stand for themselves."""
    moved = found.filter("outcome = 'REBUILT'").groupBy(P.home_relative(F.col("new_path")).alias("rel")).agg(F.min("id_hex").alias("rebuilt_hex"))
    edits = notes(nodes).select("id_hex", F.substring_index("title", " — edited ", 1).alias("rel"), "title").filter(F.contains("title", F.lit(" — edited "))).drop("title")
    return edits.join(moved, "rel").filter("id_hex <> rebuilt_hex").select("id_hex", "rebuilt_hex")


def removal_log(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id_hex, path, outcome, title, body): what is logged of each note before it goes, its body on one line; rebuilt notes log their move, `old -> new`."""
    n = notes(nodes).join(found, "id_hex")
    path = F.when(F.col("outcome") == "REBUILT", F.concat_ws(" -> ", "path", "new_path")).otherwise(F.col("path"))
    gone = F.col("outcome") != "REBUILT"
    return n.select("id_hex", path.alias("path"), "outcome", F.when(gone, F.col("title")).alias("title"), F.when(gone, T.one_line(F.coalesce("body", F.lit("")))).alias("body"))


def totals(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(total, stale, rebuilt, removed, ambiguous) by note; ambiguous ones are among the removed."""
    of = lambda o: F.count_if(F.col("outcome") == o)
    total = notes(nodes).agg(F.count("*").alias("total"))
    return total.crossJoin(found.agg(F.count("*").alias("stale"), of("REBUILT").alias("rebuilt"), F.count_if(F.col("outcome") != "REBUILT").alias("removed"), of("AMBIGUOUS").alias("ambiguous")))


def inventory_rows(inventory: DataFrame, live: DataFrame) -> DataFrame:
    """The rows of an inventory (path, purpose, keywords) that are seeded: no comment, no blank path, no auto-sync note, and the file is there."""
    ok = inventory.filter((F.trim("path") != "") & ~F.startswith("path", F.lit("#")) & ~F.contains(F.coalesce("purpose", F.lit("")), F.lit("auto-sync")))
    return ok.join(live.select("path"), "path", "left_semi")


def seed(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace by title: fresh rows push out existing ones of their title."""
    return existing.join(fresh.select("title").distinct(), "title", "left_anti").select(fresh.columns).unionByName(fresh)


def insert_note(existing: DataFrame, title: str, body: str, keywords: str = "") -> DataFrame:
    """existing (id_hex, title, body, keywords) and one note; title and body must not be blank, keywords are separated by commas. The id is a hash of both, so that a repeated insert changes nothing."""
    if not title.strip() or not body.strip():
        raise ValueError("a note needs a title and a body")
    words = sorted({k.strip() for k in keywords.split(",") if k.strip()})
    row = existing.sparkSession.createDataFrame([(title, body, words)], "title string, body string, keywords array<string>")
    row = row.select(F.substring(F.sha2(F.concat_ws("\u0000", "title", "body"), 256), 1, 16).alias("id_hex"), "title", "body", "keywords")
    return existing.join(F.broadcast(row.select("id_hex")), "id_hex", "left_anti").select(row.columns).unionByName(row)


def dump(nodes: DataFrame, node_keywords: DataFrame) -> DataFrame:
    """(id_hex, title, keywords): every note with its sorted keywords, empty if it has none."""
    k = node_keywords.groupBy("id_hex").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    return notes(nodes).join(k, "id_hex", "left").select("id_hex", "title", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ",").alias("keywords"))
