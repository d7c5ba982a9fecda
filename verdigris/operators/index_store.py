"""What has been parsed, kept by file and brought up to date by parsing only files that changed.

A store is a folder of logs (see streaming.replace_log). ``files`` is the manifest, one row for each file with the stamp by which a change is
noticed; it is written last, so that an update that breaks off is done again, which replaces the same keys by the same rows. The other logs
hold what was made of the files:

* FactStore: facts and suppressions by file. Rules, also ones that are added later, run over them without a parse.
* IndexStore: symbols, imports and bases by file, vectors by file and model, and the tables in which the last writer wins, by name.
  Of these only names are looked up anew that stood or stand in a changed file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.scratch import delete, drop, keep
from verdigris.schemas import FACTS
from verdigris.streaming.replace_log import ReplaceLog

VERSION = 2
MANIFEST = "file string, stamp string"


def by_time(files: DataFrame) -> Column:
    """A file's time of change as its stamp."""
    return F.unix_micros("mtime").cast("string")


def by_content(files: DataFrame) -> Column:
    """A digest of the text, for files whose times say nothing."""
    return F.sha2("source", 256)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file, change) of two manifests (file, stamp): new, changed or gone. Files that stay are no rows; null stamps are equal."""
    both = before.select("file", F.col("stamp").alias("old"), F.lit(True).alias("was")).join(now.select("file", F.col("stamp").alias("new"), F.lit(True).alias("is")), "file", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select("file", change.alias("change")).where("change is not null")


class Store:
    """The manifest, and what all stores share. files are (path, source, mtime)."""

    def __init__(self, spark: SparkSession, path: str, stamp=by_time):
        self.spark, self.path, self.stamp = spark, f"{path.rstrip('/')}/v{VERSION}", stamp
        self.files = self.log("files", "file")

    def log(self, name: str, key: str) -> ReplaceLog:
        return ReplaceLog(self.spark, f"{self.path}/{name}", key)

    def manifest(self, files: DataFrame) -> DataFrame:
        return files.select(F.col("path").alias("file"), self.stamp(files).alias("stamp"))

    def changes(self, files: DataFrame) -> DataFrame:
        """(file, change) of what files differ in from what is stored."""
        return changes(self.files.current(MANIFEST), self.manifest(files))

    def update(self, files: DataFrame) -> int:
        """Brings the store up to date; how many files were parsed."""
        found = keep(self.changes(files), "changes")
        n = found.groupBy("change").count().collect()
        count = {r["change"]: r["count"] for r in n}
        if count:
            changed = self._since(files, found).join(found.where("change <> 'gone'").select(F.col("file").alias("path")), "path", "left_semi")
            self.replace(found.select("file"), changed)
            self.files.append(found.select("file"), self.manifest(changed))
        drop(found)
        return count.get("new", 0) + count.get("changed", 0)

    def _since(self, files: DataFrame, found: DataFrame) -> DataFrame:
        """files without those that are older than every changed one, which a file source then need not open."""
        if self.stamp is not by_time:
            return files
        changed = files.select(F.col("path").alias("file"), "mtime").join(found.where("change <> 'gone'"), "file", "left_semi")
        unknown, since = changed.agg(F.count_if(F.col("mtime").isNull()), F.min("mtime")).first()
        return files if unknown or since is None else files.where(F.col("mtime") >= F.lit(since))

    def replace(self, touched: DataFrame, changed: DataFrame) -> None:
        """Takes out what stands of the files touched (file) and puts in what is made of the files changed."""
        raise NotImplementedError

    def clear(self) -> None:
        delete(self.spark, self.path)


class FactStore(Store):
    """Facts of files, from which they can be reviewed at any time."""

    SUPPRESSIONS = "file string, line int, code string"

    def __init__(self, spark: SparkSession, path: str, stamp=by_time):
        super().__init__(spark, path, stamp)
        self.fact_log, self.noqa_log = self.log("facts", "file"), self.log("suppressions", "file")

    def replace(self, touched: DataFrame, changed: DataFrame) -> None:
        from verdigris.functions.text import noqa_rows
        from verdigris.sources.files import spread
        from verdigris.sources.parse import syntax_facts

        own = changed.select(F.col("path").alias("file"), "source")
        self.fact_log.append(touched, syntax_facts(spread(own, "file"), ("file",)))
        self.noqa_log.append(touched, noqa_rows(own, ("file",)))

    def facts(self) -> DataFrame:
        """FACTS by path."""
        empty = ", ".join(["file string", *(f"{f.name} {f.dataType.simpleString()}" for f in FACTS)])
        return self.fact_log.current(empty).withColumnRenamed("file", "path")

    def suppressions(self) -> DataFrame:
        return self.noqa_log.current(self.SUPPRESSIONS).withColumnRenamed("file", "path")

    def review(self, codes: list[str] | None = None) -> DataFrame:
        """The findings of all stored files, as report.review gives them of their texts."""
        from verdigris.operators.report import review_facts

        return review_facts(self.facts(), self.suppressions(), codes)


class IndexStore(Store):
    """A CodeIndex by file, with vectors by model."""

    SYMBOLS = "file string, kind string, ord int, symbol string, chunk_kind string, signature string, docstring string, body string, target string"
    WINNERS = "name string, kind string, file string, ord int"
    VECTORS = "file string, ord int, embedding array<double>, error string"

    def __init__(self, spark: SparkSession, path: str, encoder=None, model: str = "", stamp=by_time):
        super().__init__(spark, path, stamp)
        self.encoder = encoder
        self.rows, self.winners, self.pending = self.log("symbols", "file"), self.log("winners", "name"), self.log("pending", "name")
        self.vectors = self.log(f"vectors-{model or 'default'}".replace("/", "_").replace(":", "_"), "file") if encoder else None

    def replace(self, touched: DataFrame, changed: DataFrame) -> None:
        from verdigris.sources.files import spread
        from verdigris.sources.parse import symbol_rows

        fresh = keep(symbol_rows(spread(changed.select(F.col("path").alias("file"), "source"), "file"), ("file",)), "symbols")
        names = self._named(self.rows.current(self.SYMBOLS).join(touched, "file", "left_semi").unionByName(fresh)).select("name")
        # names of an update that broke off are still to be looked up, though their old rows may be gone
        names = keep(names.unionByName(self.pending.current("name string")).distinct(), "names")
        self.pending.append(names, names)
        self.rows.append(touched, fresh)
        standing = self._named(self.rows.current()).join(names, "name", "left_semi")
        last = standing.groupBy("name").agg(F.max_by(F.struct("kind", "file", "ord"), F.struct("file", "ord")).alias("x")).select("name", "x.*")
        self.winners.append(names, last)
        self.pending.append(names, names.where("false"))
        drop(fresh, names)

    @staticmethod
    def _named(rows: DataFrame) -> DataFrame:
        """(name, kind, file, ord) of what the last writer wins; the kind is part of the name."""
        from verdigris.functions.text import module_name

        own = F.when(F.col("kind") == "module", module_name(F.col("file"))).otherwise(F.col("symbol"))
        return rows.where("kind in ('chunk', 'module', 'base')").select(F.concat("kind", F.lit(":"), own).alias("name"), "kind", "file", "ord").distinct()

    def update(self, files: DataFrame) -> int:
        parsed = super().update(files)
        if self.vectors is not None:
            self._embed()
        return parsed

    def _embed(self) -> None:
        """Vectors of files that have none from this model, or whose chunks came after them. Chunks that failed are tried again."""
        from verdigris.operators.retrieval import embed

        chunks = self._chunks()
        stamps = self.files.current(MANIFEST)
        known = ReplaceLog(self.spark, f"{self.vectors.path}-files", "file")
        missing = keep(changes(known.current(MANIFEST), stamps).select("file"), "missing")
        if missing.isEmpty():
            drop(missing)
            return
        made = keep(embed(chunks.join(missing, "file", "left_semi"), self.encoder), "vectors")
        self.vectors.append(missing, made.select(F.col("seq.file").alias("file"), F.col("seq.ord").alias("ord"), "embedding", "error"))
        failed = made.where("error is not null").select(F.col("seq.file").alias("file")).distinct()
        known.append(missing, stamps.join(missing, "file", "left_semi").join(failed, "file", "left_anti"))
        drop(missing, made)

    def _chunks(self) -> DataFrame:
        rows = self.rows.current(self.SYMBOLS)
        return rows.where("kind = 'chunk'").select(F.struct("file", "ord").alias("seq"), "file", "symbol", F.col("chunk_kind").alias("kind"), "signature", "docstring", "body")

    def index(self):
        """The CodeIndex of what is stored."""
        from verdigris.operators.retrieval import CHUNK, CodeIndex

        rows, chunks = self.rows.current(self.SYMBOLS), self._chunks()
        won = self.winners.current(self.WINNERS)
        imports = rows.where("kind = 'import'").select("file", F.col("target").alias("module"))
        base = won.where("kind = 'base'").select("file", "ord")
        bases = rows.where("kind = 'base'").join(base, ["file", "ord"], "left_semi").select(F.col("symbol").alias("class_name"), F.col("target").alias("base")).distinct()
        modules = won.where("kind = 'module'").select(F.expr("substring(name, length('module:') + 1)").alias("module"), "file")
        first = won.where("kind = 'chunk'").select(F.struct("file", "ord").alias("seq"))
        symbols = chunks.join(first, "seq", "left_semi").select("symbol", "seq", *[c for c in CHUNK if c != "symbol"])
        vectors = errors = None
        if self.vectors is not None:
            stored = self.vectors.current(self.VECTORS).select(F.struct("file", "ord").alias("seq"), "embedding", "error")
            vectors, errors = stored.where("error is null").select("seq", "embedding"), stored.where("error is not null").select("seq", "error")
        return CodeIndex(chunks, imports, bases, modules, symbols, vectors, errors)
