"""Documents of a snapshot, BM25 ranking, recall, import closure."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.functions import text as tx
from patchloom.functions.joins import salted_join
from patchloom.functions.tokens import analyse
from patchloom.operators.diffs import gold_files
from patchloom.session import pin

# Frame of a file in a prompt, as read back for recall.
FILE_BLOCK = r"\[start of ([\w\.\-\/]+)\]\n(?:.+?)\n\[end of \1\]"


def with_contents(files: DataFrame) -> DataFrame:
    """Document text: path, then the file."""
    return files.withColumn("contents", F.concat("path", F.lit("\n"), "content"))


def _docstrings(path: str, source: str) -> str:
    tree = ast.parse(source)
    out = [f"{path}\n{ast.get_docstring(tree) or ''}"]
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and ast.get_docstring(node):
            out.append(f"{node.name}\n{ast.get_docstring(node)}")
    return "\n\n".join(out)


def _qualified(path: str, source: str) -> str:
    """Module, then every definition by full name, docstrings below."""
    tree = ast.parse(source)
    module = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")

    def entry(name: str, doc: str | None) -> str:
        return f"{name}\n" + (f"{doc}\n\n" if doc else "")

    def visit(node: ast.AST, prefix: str, top: bool) -> Iterator[str]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield entry(f"{prefix}.{child.name}", ast.get_docstring(child))
                yield from visit(child, f"{prefix}.{child.name}", False)
            elif top and isinstance(child, ast.Assign):
                yield from (entry(f"{prefix}.{t.id}", None) for t in child.targets if isinstance(t, ast.Name))

    return f"{path}\n" + entry(module, ast.get_docstring(tree)) + "".join(visit(tree, module, True))


def _encode(files: DataFrame, encode: Callable[[str, str], str]) -> DataFrame:
    keep = [c for c in files.columns if c != "content"]
    schema = files.select(*keep, F.lit("").alias("contents")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    texts.append(encode(path, content))
                except (SyntaxError, ValueError, RecursionError):
                    texts.append(f"{path}\n{content}")  # a file that does not parse is used as it is
            yield batch[keep].assign(contents=texts)

    return files.select(*keep, "content").mapInPandas(run, schema)


def with_docstrings(files: DataFrame) -> DataFrame:
    """Document text: path, module docstring, names and docstrings of definitions."""
    return _encode(files, _docstrings)


def with_signatures(files: DataFrame) -> DataFrame:
    """Document text: path and full names of the definitions of the module, with docstrings."""
    return _encode(files, _qualified)


DOCUMENT_ENCODERS = {
    "file_name_and_contents": with_contents,
    "file_name_and_documentation": with_docstrings,
    "file_name_and_signatures": with_signatures,
}


IMPACTS = 64  # blocks of a term's postings, by impact
_MARGIN = 1e-6  # bounds are this much looser than sums of doubles need


class Postings:
    """Postings of the words that queries ask for, in blocks of similar impact.

    ``impacts`` is (corpus, term, docid, impact, block): what a document adds to a score per unit of a
    term's weight, and the block it falls into by that. ``blocks`` has each block's highest and lowest
    impact and size, ``asked`` (query_id, corpus, term, weight, most, kth): the most that a term can add,
    and what it adds at least to each of its best ``k`` documents.
    """

    def __init__(self, impacts: DataFrame, blocks: DataFrame, terms: DataFrame):
        self.impacts, self.blocks, self.terms = impacts, blocks, terms

    @classmethod
    def of(cls, queries: DataFrame, docs: DataFrame, k1: float = 0.9, b: float = 0.4, analyser: Callable[[Column], Column] = analyse) -> Postings:
        terms = pin(queries.select("query_id", "corpus", F.explode(analyser(F.col("query"))).alias("term")).groupBy(
            "query_id", "corpus", "term").agg(F.count(F.lit(1)).alias("qtf")))
        # the empty term stands for "every document": its postings carry the corpus statistics,
        # so the documents are read and analysed once
        every = F.lit("")
        asked = terms.select("corpus", "term").union(queries.select("corpus", every)).distinct()
        words = docs.select("corpus", "docid", analyser(F.col("contents")).alias("w"))
        counted = pin(
            words.select("corpus", "docid", F.size("w").alias("dl"), F.explode(F.array_append("w", every)).alias("term"))
            .join(asked, ["corpus", "term"], "left_semi")
            .groupBy("corpus", "term", "docid", "dl").agg(F.count(F.lit(1)).alias("tf"))
        )
        stats = counted.filter(F.col("term") == every).groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
        impact = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
        impacts = pin(counted.filter(F.col("term") != every).join(stats, "corpus").select("corpus", "term", "docid", impact.alias("impact")).withColumn(
            "block", F.floor(F.col("impact") * IMPACTS).cast("int")))
        blocks = pin(impacts.groupBy("corpus", "term", "block").agg(
            F.max("impact").alias("high"), F.min("impact").alias("low"), F.count(F.lit(1)).alias("n")))
        df = blocks.groupBy("corpus", "term").agg(F.sum("n").alias("df"))
        weight = F.col("qtf") * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = terms.join(df, ["corpus", "term"]).join(stats, "corpus").select("query_id", "corpus", "term", weight.alias("weight"))
        return cls(impacts, blocks, pin(weighted))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """(query_id, docid, score) of (query_id, corpus, docid), over all terms of the query."""
        held = pairs.join(self.impacts, ["corpus", "docid"]).join(self.terms, ["query_id", "corpus", "term"])
        return held.groupBy("query_id", "docid").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))

    def floors(self, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, corpus, term, weight, most) and (query_id, least): a score that ``k`` documents reach.

        A term whose ``k`` best documents are good promises a score; those documents are scored in full,
        and the worst of them sets ``least``. Queries without such a term are missing.
        """
        best_first = Window.partitionBy("corpus", "term").orderBy(F.desc("block"))  # at most IMPACTS rows and one
        each = self.blocks.withColumn("so_far", F.sum("n").over(best_first)).groupBy("corpus", "term").agg(
            F.max("high").alias("high"), F.max(F.when(F.col("so_far") >= k, F.col("low"))).alias("kth"))
        asked = pin(self.terms.join(each, ["corpus", "term"]).select("query_id", "corpus", "term", "weight", (F.col("weight") * F.col("high")).alias("most"), "kth"))
        promise = asked.filter(F.col("kth").isNotNull()).groupBy("query_id", "corpus").agg(
            F.max(F.struct(F.col("weight") * F.col("kth"), "term", "kth")).alias("b")).select("query_id", "corpus", "b.term", "b.kth")
        first = Window.partitionBy("query_id").orderBy(F.desc("impact"), "docid")
        seeds = salted_join(self.impacts, promise, ["corpus", "term"], ["docid"]).filter(F.col("impact") >= F.col("kth")).withColumn(
            "r", F.row_number().over(first)).filter(F.col("r") <= k).select("query_id", "corpus", "docid")
        return asked, pin(self.scores(seeds).groupBy("query_id").agg(F.min("score").alias("least")))

    def candidates(self, k: int) -> DataFrame:
        """(query_id, corpus, docid) of all documents that may be among the ``k`` best, and few others.

        Terms that together can't reach the floor call no documents. Of the others, only blocks whose
        highest impact reaches it with the most that all other terms could add.
        """
        asked, least = self.floors(k)
        bounded = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - _MARGIN)
        upwards = Window.partitionBy("query_id").orderBy("most", "term")  # the terms of one query
        calling = bounded.withColumn("below", F.sum("most").over(upwards.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
            "total", F.sum("most").over(Window.partitionBy("query_id"))).filter("below >= least")
        open_blocks = calling.join(self.blocks, ["corpus", "term"]).filter("weight * high + total - most >= least").select("query_id", "corpus", "term", "block")
        return salted_join(self.impacts, open_blocks, ["corpus", "term", "block"], ["docid"]).select("query_id", "corpus", "docid").distinct()


def bm25_topk(
    queries: DataFrame, docs: DataFrame, k: int = 20, k1: float = 0.9, b: float = 0.4,
    analyser: Callable[[Column], Column] = analyse, digits: int = 6,
) -> DataFrame:
    """(query_id, rank, docid, score): the best ``k`` documents of each query's own corpus.

    ``queries`` has query_id, corpus, query; ``docs`` has corpus, docid, contents. A
    corpus is a snapshot, so shared snapshots are scored from one posting table. Every
    query term counts; a long query is not shortened.

    The result is that of scoring all documents. Documents whose blocks can't lift them to the
    ``k`` best are never joined; see ``Postings``. Ranks go by the score to ten digits, then by
    docid, so equal documents keep their order whatever order their sums were taken in.
    """
    index = Postings.of(queries, docs, k1, b, analyser)
    exact = index.scores(index.candidates(k)).withColumn("exact", F.round("score", 10))
    w = Window.partitionBy("query_id").orderBy(F.desc("exact"), "docid")
    return exact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "docid", F.round("exact", digits).alias("score")
    )


def recall_of(hits: DataFrame, gold: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, n_gold, recall) for every key with gold documents; no hits give recall 0."""
    wanted = gold.select(key, "docid").distinct()
    found = wanted.join(hits.select(key, "docid").distinct().withColumn("_hit", F.lit(1)), [key, "docid"], "left")
    return found.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_gold"), (F.count("_hit") / F.count(F.lit(1))).alias("recall")
    )


def recall_from_text(rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """(key, n_gold, recall) read back from prompts (``text``) and gold patches (``patch``)."""
    blocks = tx.find_all(F.col("text"), FILE_BLOCK, 1, "s")
    blocks = F.when(F.lower(F.get(blocks, F.lit(0))).contains("readme"), F.slice(blocks, F.lit(2), F.size(blocks))).otherwise(blocks)
    gold = gold_files(F.coalesce("patch", F.lit("")))
    return rows.select(key, F.size(gold).alias("n_gold"), F.size(F.array_intersect(blocks, gold)).alias("_n")).filter(
        F.col("n_gold") > 0).select(key, "n_gold", (F.col("_n") / F.col("n_gold")).alias("recall"))


def recall_summary(recalls: DataFrame) -> DataFrame:
    r = F.col("recall")
    return recalls.agg(
        F.round(F.avg(r) * 100, 6).alias("avg_recall"),
        F.round(F.avg((r == 1).cast("int")) * 100, 6).alias("all_recall"),
        F.round(F.avg((r > 0).cast("int")) * 100, 6).alias("any_recall"),
    )


def remaining(rows: DataFrame, written: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows not yet written."""
    return rows.join(written.select(key), key, "left_anti")


def attach_hits(instances: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Instances with ``hits``: their first k docids by rank, an empty list when there are none."""
    # at most k rows per instance reach the list
    best = hits.filter(F.col("rank") <= k).groupBy("instance_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "docid"))), lambda s: s["docid"]).alias("_hits")
    )
    return instances.join(best, "instance_id", "left").withColumn(
        "hits", F.coalesce("_hits", F.array().cast("array<string>"))
    ).drop("_hits")


def import_edges(files: DataFrame) -> DataFrame:
    """(repo, commit, src, dst): files that a file's import statements reach.

    A module names the directory whose path ends in its parts; all Python files of the
    first such directory, by path, are reached. Suffixes of directory paths make this an
    equi-join. Paths start with the repository's folder name.
    """
    schema = "repo string, commit string, src string, module string, level int"

    def imports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for repo, commit, path, content in batch.itertuples(index=False):
                try:
                    body = ast.parse(content).body
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for node in body:
                    if isinstance(node, ast.Import):
                        out += [(repo, commit, path, a.name, 0) for a in node.names]
                    elif isinstance(node, ast.ImportFrom) and node.module:
                        out.append((repo, commit, path, node.module, node.level))
            yield pd.DataFrame(out, columns=["repo", "commit", "src", "module", "level"])

    python = files.filter(F.col("path").endswith(".py"))
    parts = F.split("module", "[.]")
    wanted = python.select("repo", "commit", "path", "content").mapInPandas(imports, schema).select(
        "repo", "commit", "src",
        F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.col("level"), F.lit(0))), "/").alias("suffix"),
    ).distinct()
    root = F.replace("repo", F.lit("/"), F.lit("__"))
    full = F.concat(root, F.lit("/"), "path")
    placed = python.select("repo", "commit", "path", F.regexp_replace(full, "/[^/]*$", "").alias("dir"))
    dirs = placed.select("repo", "commit", "dir").distinct()
    # only suffixes of a length that some import of the snapshot asks for
    lengths = wanted.select("repo", "commit", F.length("suffix").alias("n")).distinct()
    suffixes = dirs.join(lengths, ["repo", "commit"]).filter(F.col("n") <= F.length("dir")).select(
        "repo", "commit", "dir", F.expr("right(dir, n)").alias("suffix"))
    target = wanted.join(suffixes, ["repo", "commit", "suffix"]).groupBy("repo", "commit", "src", "suffix").agg(
        F.min("dir").alias("dir"))
    return target.join(placed, ["repo", "commit", "dir"]).select("repo", "commit", "src", F.col("path").alias("dst")).distinct()


def import_closure(edges: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seed, node): every node reachable from each seed, the seed included.

    One join per round over the newly reached rows only; each round is written to the
    checkpoint folder, so a lost executor repeats no earlier round.
    """
    reached = pin(seeds.select(*keys, "seed", F.col("seed").alias("node")).distinct())
    frontier = reached
    while True:
        step = frontier.join(edges.withColumnRenamed("src", "node"), [*keys, "node"]).select(
            *keys, "seed", F.col("dst").alias("node")
        ).distinct()
        frontier = pin(step.join(reached, [*keys, "seed", "node"], "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def readme_files(files: DataFrame, shortest_only: bool = False) -> DataFrame:
    """Root files whose name starts with 'readme'; optionally the one with the shortest name."""
    found = files.filter(~F.col("path").contains("/") & F.lower("path").startswith("readme"))
    if not shortest_only:
        return found
    return found.groupBy("repo", "commit").agg(
        F.min_by(F.struct(*[c for c in files.columns if c not in ("repo", "commit")]), F.struct(F.length("path"), "path")).alias("f")
    ).select("repo", "commit", "f.*")
