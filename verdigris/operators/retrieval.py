"""Symbol chunks, import and base graph, and hybrid retrieval for all files at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.text import centroid, module_name, prefixes
from verdigris.operators.scratch import keep
from verdigris.sources.files import spread
from verdigris.sources.parse import symbol_rows

CHUNK = ["file", "symbol", "kind", "signature", "docstring", "body"]
Encoder = Callable[[pd.Series], pd.Series]


def chunk_text(kind="kind", signature="signature", docstring="docstring", body="body"):
    """What is embedded of a chunk; empty parts are left out."""
    part = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), c))
    return F.concat_ws("\n", F.concat_ws(" ", kind, signature), part("docstring: ", docstring), part("body: ", body))


@dataclass
class CodeIndex:
    """chunks (seq, file, symbol, kind, signature, docstring, body), imports (file, module), bases (class_name, base),
    modules (module, file), symbols (one chunk for each name), vectors (seq, embedding) or None, and errors (seq, error) of
    chunks that could not be embedded, or None."""

    chunks: DataFrame
    imports: DataFrame
    bases: DataFrame
    modules: DataFrame
    symbols: DataFrame
    vectors: DataFrame | None = None
    errors: DataFrame | None = None

    @classmethod
    def build(cls, files: DataFrame, encoder: Encoder | None = None) -> CodeIndex:
        """The index of files (path root-relative, source). Of equal symbols, classes and modules the last by path wins."""
        rows = keep(symbol_rows(spread(files.withColumn("file", F.col("path")), "file"), ("file",)), "symbols")
        # a sequence number in path order without a global sort: the path itself leads, then the place in the file
        at = F.struct("file", "ord")
        chunks = rows.where("kind = 'chunk'").select(at.alias("seq"), "file", "symbol", F.col("chunk_kind").alias("kind"), "signature", "docstring", "body")
        imports = rows.where("kind = 'import'").select("file", F.col("target").alias("module"))
        defined = rows.where("kind = 'base'").select("symbol", "target", at.alias("seq"))
        last = defined.groupBy("symbol").agg(F.max("seq").alias("seq"))
        bases = defined.join(last, ["symbol", "seq"]).select(F.col("symbol").alias("class_name"), F.col("target").alias("base")).distinct()
        modules = rows.where("kind = 'module'").select(module_name(F.col("file")).alias("module"), "file").groupBy("module").agg(F.max("file").alias("file"))
        symbols = chunks.groupBy("symbol").agg(F.max_by(F.struct("seq", *[c for c in CHUNK if c != "symbol"]), "seq").alias("c")).select("symbol", "c.*")
        if encoder is None:
            return cls(chunks, imports, bases, modules, symbols)
        embedded = keep(embed(chunks, encoder), "vectors")
        return cls(chunks, imports, bases, modules, symbols, embedded.where("error is null").select("seq", "embedding"), embedded.where("error is not null").select("seq", "error"))

    def embedding_failure(self) -> DataFrame:
        """(chunks, error): one row if chunks could not be embedded and are found by structure alone, with the first error; else none."""
        if self.errors is None:
            return self.chunks.sparkSession.createDataFrame([], "chunks long, error string")
        return self.errors.agg(F.count("*").alias("chunks"), F.min_by("error", "seq").alias("error")).where("chunks > 0")

    def own_symbols(self) -> DataFrame:
        return self.chunks.select("file", "symbol").distinct()

    def own_bases(self) -> DataFrame:
        """(file, class_name, base): bases of classes that a file defines; a name counts wherever it is defined."""
        return self.own_symbols().join(self.bases, F.col("symbol") == F.col("class_name")).select("file", "class_name", "base")

    def imported_files(self) -> DataFrame:
        """(file, target): the indexed file of the longest prefix of each imported module."""
        tried = self.imports.select("file", "module", F.explode(prefixes(F.col("module"))).alias("p")).select("file", F.col("module").alias("wanted"), "p.*")
        found = tried.join(self.modules.withColumnRenamed("file", "target"), F.col("prefix") == F.col("module"))
        best = found.groupBy("file", "wanted").agg(F.max_by("target", "depth").alias("target"))
        return best.where("target <> file").select("file", "target").distinct()

    def structural(self) -> DataFrame:
        """(for_file, tier, rank, seq, chunk columns): chunks of bases first, by base name, then those of imported files."""
        chunk = F.struct("seq", *CHUNK).alias("c")
        by_base = self.own_bases().withColumnRenamed("file", "for_file").join(self.symbols.select(F.col("symbol").alias("base"), F.struct("seq", "file", F.col("symbol"), "kind", "signature", "docstring", "body").alias("c")), "base").where("c.file <> for_file")
        by_base = by_base.select("for_file", F.lit(0).alias("tier"), F.struct(F.lit("").alias("file"), F.col("base").alias("name"), F.lit(0).alias("ord")).alias("place"), "c")
        by_import = self.imported_files().withColumnRenamed("file", "for_file").join(self.chunks.select(F.col("file").alias("target"), chunk), "target")
        by_import = by_import.select("for_file", F.lit(1).alias("tier"), F.struct(F.col("target").alias("file"), F.lit("").alias("name"), F.col("c.seq.ord").alias("ord")).alias("place"), "c")
        first = F.row_number().over(Window.partitionBy("for_file", "c.symbol").orderBy("tier", "place"))
        kept = by_base.unionByName(by_import).withColumn("_n", first).where("_n = 1")
        rank = F.row_number().over(Window.partitionBy("for_file").orderBy("tier", "place"))
        return kept.select("for_file", "tier", rank.alias("rank"), "c.*")

    def semantic(self, top_k: int = 5, block: int = 2000) -> DataFrame:
        """(for_file, rank, sim, chunk columns): the most similar chunks of other files, one for each symbol, that are not structural hits.

        Each file's query is the mean of its chunks' vectors."""
        if self.vectors is None:
            return self.structural().where("false").select("for_file", "rank", F.lit(0.0).alias("sim"), "seq", *CHUNK)
        with_vectors = self.chunks.join(self.vectors, "seq")
        queries = centroid(with_vectors.select("file", "embedding"), "file", "embedding").select(F.col("file").alias("query"), F.col("file").alias("owner"), F.col("centroid").alias("q"))
        order = F.struct(F.col("seq.file"), F.col("seq.ord").cast("long").alias("ord"))
        vectors = with_vectors.select(order.alias("at"), F.col("file").alias("owner"), F.col("symbol").alias("name"), "embedding")
        seen = self.structural().select(F.col("for_file").alias("query"), F.col("symbol").alias("name"))
        top = nearest(queries, vectors, top_k, seen, block).select(F.col("query").alias("for_file"), "rank", "sim", "at")
        chunks = self.chunks.select("seq", *CHUNK).withColumn("at", order)
        return top.join(chunks, "at").select("for_file", "rank", "sim", "seq", *CHUNK)

    def related(self, top_k: int = 5) -> DataFrame:
        """(for_file, rank, chunk columns): structural hits, then semantic ones in the places that are left."""
        s = self.structural().select("for_file", F.lit(0).alias("part"), "rank", *CHUNK)
        m = self.semantic(top_k).select("for_file", F.lit(1).alias("part"), "rank", *CHUNK)
        rank = F.row_number().over(Window.partitionBy("for_file").orderBy("part", "rank"))
        return s.unionByName(m).withColumn("rank", rank).where(F.col("rank") <= top_k).drop("part")

    def signatures(self) -> DataFrame:
        """(file, modules, bases): what a file imports and inherits, sorted."""
        files = self.chunks.select("file").distinct()
        modules = self.imports.groupBy("file").agg(F.sort_array(F.collect_set("module")).alias("modules"))
        bases = self.own_bases().groupBy("file").agg(F.sort_array(F.collect_set("base")).alias("bases"))
        none = F.array().cast("array<string>")
        return files.join(modules, "file", "left").join(bases, "file", "left").select("file", F.coalesce("modules", none).alias("modules"), F.coalesce("bases", none).alias("bases"))

    def siblings(self) -> Siblings:
        """Who shares a base with whom, by membership; see Siblings."""
        members = self.own_bases().select("file", "base").distinct()
        classes = self.bases.join(self.symbols.select(F.col("symbol").alias("class_name"), F.col("file").alias("sibling")), "class_name").select("base", "class_name", "sibling").distinct()
        known = self.own_symbols().withColumnRenamed("symbol", "class_name").join(classes, "class_name").select("file", "base", "class_name", "sibling").distinct()
        return Siblings(members, classes, known)

    def siblings_match(self) -> DataFrame:
        """(file, matches): whether any sibling has the file's own signature."""
        s = self.signatures().withColumn("sig", F.xxhash64("modules", "bases", F.to_json(F.struct("modules", "bases")))).select("file", "sig")
        found = self.siblings().matches(s)
        return s.select("file").join(found, "file", "left").select("file", F.coalesce("matches", F.lit(False)).alias("matches"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, files: DataFrame, encoder: Encoder | None = None, model: str = "", stamp=None) -> CodeIndex | None:
        """The stored index, or None if there is none that reads, or files differ from those that it was made of."""
        from verdigris.operators.index_store import IndexStore, by_time

        store = IndexStore(spark, path, encoder, model, stamp or by_time)
        try:
            return store.index() if store.files.next_seq() and store.changes(files).isEmpty() and (encoder is None or store.vectors.next_seq()) else None
        except Exception as e:  # an index is a cache: whatever keeps it from being read, it is built again
            if type(e).__name__ not in UNREADABLE:
                raise
            return None

    @classmethod
    def open(cls, spark: SparkSession, path: str, files: DataFrame, encoder: Encoder | None = None, model: str = "", stamp=None) -> CodeIndex:
        """The stored index, brought up to date by parsing and embedding what changed; a store that does not read is made anew, and
        an index is built without one if it cannot be written."""
        from verdigris.operators.index_store import IndexStore, by_time

        store = IndexStore(spark, path, encoder, model, stamp or by_time)
        for fresh in (False, True):
            try:
                if fresh:
                    store.clear()
                store.update(files)
                return store.index()
            except Exception as e:
                if type(e).__name__ not in UNREADABLE:
                    raise
        return cls.build(files, encoder)


UNREADABLE = ("AnalysisException", "Py4JJavaError", "SparkException", "IllegalArgumentException")


@dataclass
class Siblings:
    """Files whose classes share a base, without a row for each pair, so that a base such as Exception costs what it has classes.

    members (file, base): the bases of a file's classes. classes (base, class_name, sibling): the classes of a base, each in the file that
    defined its name last. known (file, base, class_name, sibling): those of them whose name the file has itself, its own among them.
    A file's siblings are the files of its bases' classes, less those of which it knows all classes of the base."""

    members: DataFrame
    classes: DataFrame
    known: DataFrame

    def counts(self) -> DataFrame:
        """(file, base, siblings): how many siblings a file has through each base, if any."""
        homes = self.classes.groupBy("base", "sibling").agg(F.count("*").alias("all"))
        total = homes.groupBy("base").agg(F.count("*").alias("homes"))
        seen = self.known.groupBy("file", "base", "sibling").agg(F.count("*").alias("own")).join(homes, ["base", "sibling"])
        lost = seen.where("own = all").groupBy("file", "base").agg(F.count("*").alias("lost"))
        left = self.members.join(total, "base").join(lost, ["file", "base"], "left").select("file", "base", (F.col("homes") - F.coalesce("lost", F.lit(0))).alias("siblings"))
        return left.where("siblings > 0")

    def totals(self) -> DataFrame:
        """(file, siblings): how many different siblings a file has through all its bases, if any, as pairs() would list them.

        Files of the same bases reach the same files, so each set of bases is counted once. A base gives the number of its files; what has been counted
        more than once is a file that shares two bases or more with the set, and is taken off by sets of bases that have two in common. Hence a base that
        all files have costs no pairs."""
        own, homes = _base_sets(self.members, "file"), _base_sets(self.classes.select(F.col("sibling").alias("file"), "base").distinct(), "file")
        single = homes.select(F.explode("bases").alias("base"), "file").groupBy("base").agg(F.count("*").alias("homes"))
        wanted = own.select("bases").distinct()
        reached = wanted.select("bases", F.explode("bases").alias("base")).join(single, "base").groupBy("bases").agg(F.sum("homes").alias("reached"))
        two = F.explode(F.flatten(F.transform("bases", lambda x, i: F.transform(F.slice("bases", i + 2, F.size("bases")), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("two")
        many = wanted.where(F.size("bases") > 1).select("bases", two)
        other = homes.where(F.size("bases") > 1).groupBy("bases").agg(F.count("*").alias("n")).select("n", F.col("bases").alias("others"), two)
        met = many.join(other, "two").select("bases", "others", "n").distinct()
        twice = met.groupBy("bases").agg(F.sum(F.col("n") * (F.size(F.array_intersect("bases", "others")) - 1)).alias("twice"))
        # a file is lost where all of its classes of these bases are known by name
        each = self.classes.groupBy("base", "sibling").agg(F.count("*").alias("all"))
        seen = self.known.join(self.members, ["file", "base"], "left_semi").groupBy("file", "sibling").agg(F.count("*").alias("own"))
        there = seen.join(self.members, "file").join(each, ["base", "sibling"]).groupBy("file", "sibling").agg(F.first("own").alias("own"), F.sum("all").alias("all"))
        lost = there.where("own = all").groupBy("file").agg(F.count("*").alias("lost"))
        left = own.join(reached, "bases").join(twice, "bases", "left").join(lost, "file", "left")
        return left.select("file", (F.col("reached") - F.coalesce("twice", F.lit(0)) - F.coalesce("lost", F.lit(0))).alias("siblings")).where("siblings > 0")

    def pairs(self, files: DataFrame) -> DataFrame:
        """(file, sibling), each once, for the files (file) that are asked for: what a prompt on them needs."""
        wanted = files.select("file").distinct()
        found = self.members.join(wanted, "file", "left_semi").join(self.classes, "base")
        fresh = found.join(self.known.join(wanted, "file", "left_semi").select("file", "class_name").distinct(), ["file", "class_name"], "left_anti")
        return fresh.where("sibling <> file").select("file", "sibling").distinct()

    def matches(self, signatures: DataFrame) -> DataFrame:
        """(file, matches) by counts of classes of each base and signature (file, sig), less those that the file knows."""
        of = signatures.select(F.col("file").alias("sibling"), "sig")
        every = self.classes.join(of, "sibling").groupBy("base", "sig").agg(F.count("*").alias("all"))
        own = self.known.join(of, "sibling").groupBy("file", "base", "sig").agg(F.count("*").alias("own"))
        found = self.members.join(signatures.select("file", "sig"), "file").join(every, ["base", "sig"]).join(own, ["file", "base", "sig"], "left")
        return found.groupBy("file").agg(F.max(F.col("all") > F.coalesce("own", F.lit(0))).alias("matches"))


def _base_sets(members: DataFrame, key: str) -> DataFrame:
    """(key, bases) of (key, base): the sorted set of bases."""
    return members.groupBy(key).agg(F.sort_array(F.collect_set("base")).alias("bases"))


def default_path(root: str) -> str:
    """Where a project's index is kept."""
    return f"{root.rstrip('/')}/.verdigris/index"


def nearest(queries: DataFrame, vectors: DataFrame, k: int, seen: DataFrame | None = None, block: int = 2000, digits: int | None = None) -> DataFrame:
    """(query, rank, sim, at, name): by cosine, ties by the larger at, the k nearest vectors (at, owner, name, embedding) of every
    query (query, owner, q), one for each name, of other owners, and not of the names that seen (query, name) has. With digits, cosines are rounded
    to so many decimals before they are compared, so that those that are equal then are ties.

    One plan, however many queries there are. Queries are packed into blocks and vectors into chunks of at most block rows; chunks are dealt over parts, once,
    and every block goes to every part. There a block meets the part's chunks one after the other by one matrix product each, and passes on, for
    each query, the best of as many names as it needs: k and those that it has seen."""
    spark = queries.sparkSession
    seen = queries.select("query", F.lit(None).cast("string").alias("name")).where("false") if seen is None else seen.select("query", "name").distinct()
    known = seen.groupBy("query").agg(F.count("*").alias("known"))
    own = queries.join(known, "query", "left").select("query", "owner", F.col("q").cast("array<double>").alias("q"), F.coalesce("known", F.lit(0)).alias("known"))
    rows = vectors.select("at", "owner", "name", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = {**{c: rows.schema[c].dataType.simpleString() for c in ("at", "owner", "name")}, "query": queries.schema["query"].dataType.simpleString()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _packed(own, ["query", "owner", "known"], "q", block, f"queries array<{kind['query']}>, q_owners array<{kind['owner']}>, known array<long>, q binary, dim int")
    blocks = blocks.withColumns({"block": F.monotonically_increasing_id(), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    chunks = _packed(rows, ["at", "owner", "name"], "embedding", block, f"ats array<{kind['at']}>, owners array<{kind['owner']}>, names array<{kind['name']}>, x binary, x_dim int")
    chunks = chunks.withColumn("part", F.pmod(F.xxhash64("ats"), F.lit(parts)).cast("int"))
    # a merge join gives a block all chunks of its part in a row, so that its best so far are held once
    met = blocks.hint("merge").join(chunks, "part").select("block", "queries", "q_owners", "known", "q", "dim", "ats", "owners", "names", "x", "x_dim")

    def best(batches):
        now, top = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, batch=batch, r=r: batch.column(c)[r]
                if get("dim").as_py() != get("x_dim").as_py():
                    raise ValueError("vectors of different lengths")
                if now is None or now != get("block").as_py():
                    if top is not None and (done := top.table()) is not None:
                        yield done
                    now = get("block").as_py()
                    top = Best(get("queries").values, get("q_owners").as_py(), get("known").as_py(), np.frombuffer(get("q").as_py()).reshape(len(get("queries")), get("dim").as_py()), k, digits)
                top.meet(get("ats").values, get("owners").as_py(), get("names").values, np.frombuffer(get("x").as_py()).reshape(len(get("ats")), get("x_dim").as_py()))
        if top is not None and (done := top.table()) is not None:
            yield done

    found = met.mapInArrow(best, f"query {kind['query']}, sim double, at {kind['at']}, name {kind['name']}")
    fresh = found.join(seen, ["query", "name"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query", "name").orderBy(F.desc("sim"), F.desc("at")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), F.desc("at")))
    return fresh.withColumn("_n", first).where("_n = 1").withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "sim", "at", "name")


def _packed(rows: DataFrame, labels: list[str], vector: str, most: int, schema: str) -> DataFrame:
    """Rows of at most most vectors of one length: lists of the labels, the unit vectors as bytes, and their length."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(vector).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                own = pa.Table.from_batches([batch]).take(pa.array(np.flatnonzero(sizes == dim)))
                for a in range(0, own.num_rows, most):
                    part = own.slice(a, most).combine_chunks()
                    one = lambda c, part=part: pa.concat_arrays(part[c].chunks)
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), one(c)) for c in labels]
                    x = one(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
                    yield pa.record_batch([*lists, pa.array([_unit(x).tobytes()], pa.binary()), pa.array([dim], pa.int32())], names)

    return rows.select(*labels, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)


class Best:
    """The best names of each query of a block so far."""

    def __init__(self, queries: pa.Array, owners: list, known: list[int], q: np.ndarray, k: int, digits: int | None = None):
        self.queries, self.owners, self.q, self.digits = queries, owners, q, digits
        self.most = [k + n for n in known]
        self.top: list[list[tuple]] = [[] for _ in owners]  # (sim, at as a sortable value, at, name), best first, a name once

    def meet(self, ats: pa.Array, owners: list, names: pa.Array, x: np.ndarray) -> None:
        at, name = ats.to_pylist(), names.to_pylist()
        place = [tuple(v.values()) if isinstance(v, dict) else v for v in at]
        order = np.array(sorted(range(len(at)), key=place.__getitem__, reverse=True), np.int64)
        sims, owners = (self.q @ x.T)[:, order], np.array(owners, object)[order]
        if self.digits is not None:
            sims = np.round(sims, self.digits)
        for r in range(len(self.top)):
            top, most = self.top[r], self.most[r]
            floor = top[-1][0] if len(top) == most else -np.inf
            here = np.flatnonzero((sims[r] >= floor) & (owners != self.owners[r]))
            new, labels = [], set()
            for j in here[np.argsort(-sims[r][here], kind="stable")].tolist():
                i = int(order[j])
                if name[i] not in labels:
                    labels.add(name[i])
                    new.append((float(sims[r, j]), place[i], at[i], name[i]))
                    if len(new) == most:
                        break
            if new:
                merged, labels = sorted([*top, *new], key=lambda t: t[:2], reverse=True), set()
                self.top[r] = [t for t in merged if not (t[3] in labels or labels.add(t[3]))][:most]

    def table(self) -> pa.RecordBatch | None:
        rows = [(r, sim, at, name) for r, top in enumerate(self.top) for sim, _, at, name in top]
        if not rows:
            return None
        who, sim, at, name = zip(*rows, strict=True)
        return pa.record_batch([self.queries.take(pa.array(who)), pa.array(sim, pa.float64()), pa.array(at), pa.array(name, pa.string())], ["query", "sim", "at", "name"])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; zero stays zero, which makes its similarity zero."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.round(x / np.where(norm == 0, 1, norm), 14)


def embed(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """(seq, embedding array<double>, error): texts go to the encoder in Arrow batches. A batch that the encoder fails on has the error in place
    of vectors, and the job goes on; so does one that comes back with another number of rows."""

    def run(batches):
        for batch in batches:
            n, error, found = batch.num_rows, None, None
            try:
                found = [None if v is None else [float(x) for x in v] for v in encoder(pd.Series(batch.column("text").to_pylist(), dtype=object))]
                if len(found) != n:
                    error = f"ValueError: {len(found)} vectors for {n} texts"
            except Exception as e:  # whatever an encoder raises: files are still related by structure
                error = f"{type(e).__name__}: {e}"
            errors = [error or ("ValueError: no vector" if v is None else None) for v in (found if not error else [None] * n)]
            yield pa.record_batch([batch.column("seq"), pa.array([None] * n if error else found, pa.list_(pa.float64())), pa.array(errors, pa.string())], ["seq", "embedding", "error"])

    return chunks.select("seq", chunk_text().alias("text")).mapInArrow(run, f"seq {chunks.schema['seq'].dataType.simpleString()}, embedding array<double>, error string")


def render_related(related: DataFrame) -> DataFrame:
    """(for_file, related): the prompt's lines on each related chunk."""
    line = F.concat(F.lit("  "), "file", F.lit(": "), "kind", F.lit(" "), "symbol", F.lit(" — "), "signature", F.when(F.col("docstring") != "", F.concat(F.lit("\n      "), "docstring")).otherwise(""))
    return related.groupBy("for_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("text")))), lambda r: r["text"]), "\n").alias("related"))
