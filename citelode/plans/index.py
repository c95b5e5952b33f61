"""A persistent index: ingest a corpus once, add to it, search it in batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.operators import chunking, fusion, history, keyword, postings, vectors
from citelode.operators.layout import Keyed
from citelode.operators.quality import CanaryGate
from citelode.operators.sizing import small_side, within
from citelode.providers import identity, provider
from citelode.session import cut_lineage, release_shuffles
from citelode.sources import sinks


@dataclass(frozen=True)
class IndexConfig:
    normalizer: str = "whitespace"
    embedder: str = "hashing"
    embedder_params: dict = field(default_factory=lambda: {"dims": 64})
    reranker: str = "lexical"
    sentence_count: int = 7
    sentence_overlap: int = 2
    max_tokens: int = 512
    dense_top_k: int = 20
    sparse_top_k: int = 20
    rrf_k: int = 60
    gate_threshold: float = 0.35
    top_n: int = 6

    @classmethod
    def of(cls, **settings) -> "IndexConfig":
        unknown = sorted(set(settings) - set(cls.__dataclass_fields__))
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**settings)

    def index_identity(self) -> dict[str, str]:
        """What must agree between an index and its reader."""
        return {
            "normalizer": identity(self.normalizer),
            "embedder": identity(self.embedder, **self.embedder_params),
            "chunker": identity(
                "sentences", count=self.sentence_count, overlap=self.sentence_overlap, max_tokens=self.max_tokens
            ),
        }


def fingerprinted(files: DataFrame, config: IndexConfig) -> DataFrame:
    """Files with the fingerprint of their content and of all that shapes their rows."""
    settings = F.lit(json.dumps(config.index_identity(), sort_keys=True))
    return files.withColumn("fingerprint", F.sha2(F.concat_ws("|", "text", settings), 256))


def index_rows(files: DataFrame, config: IndexConfig) -> DataFrame:
    """Files (``file, category, text``) to chunks with tokens, vector and fingerprint."""
    tokens = provider("normalizer", config.normalizer)
    embed = provider("embedder", config.embedder, **config.embedder_params)
    chunks = chunking.text_chunks(
        fingerprinted(files, config), config.sentence_count, config.sentence_overlap, config.max_tokens, keep=("fingerprint",)
    )
    return chunks.withColumn("tokens", tokens(F.col("text"))).withColumn("vector", embed(F.col("tokens")))


#: Files that a category's folder is spread over, at most.
SPREAD = 32


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by category and file, so that a category's folder has few files and a large one many writers. The number
    of tasks is fixed, since files are small beside the work that they make."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "category", F.pmod(F.xxhash64("file"), F.lit(SPREAD)))


def _write(rows: DataFrame, path: str, config: IndexConfig, passed: Callable[[], None] = lambda: None) -> None:
    """Write chunks (``dealt`` as files, before they grow) partitioned by category, so a category filter prunes folders, the keyword
    index, the texts laid out by chunk id, then the manifest; all appear at once. Every build has a staging folder of its own.
    ``passed`` is asked once the chunks are written; if it raises, the build goes and the old index stays."""
    spark = rows.sparkSession
    tokens = provider("normalizer", config.normalizer)
    staging = f"{path}.build-{uuid.uuid4().hex[:8]}"
    rows.write.partitionBy("category").option("compression", "zstd").parquet(f"{staging}/chunks")
    release_shuffles(spark)
    try:
        passed()
    except Exception:
        sinks.remove(spark, staging)
        raise
    stored = spark.read.parquet(f"{staging}/chunks")
    postings.build(stored.select("chunk_id", "category", "tokens"), f"{staging}/keywords")
    texts = stored.select("chunk_id", "file", "page", "category", "text")
    derived = lambda df: df.withColumn("tokens", tokens(F.col("text")))
    Keyed.write(texts, f"{staging}/texts", "chunk_id", stored.count(), derived=derived)
    sinks.write_text(spark, json.dumps(config.index_identity(), sort_keys=True), f"{staging}/manifest.json")
    sinks.publish(spark, staging, path)


def build(files: DataFrame, path: str, config: IndexConfig = IndexConfig(), gate: CanaryGate | None = None) -> None:
    """Index ``files`` anew. A ``gate`` watches the texts while they are indexed, without another scan,
    and stops the build before it is published."""
    if gate is None:
        _write(index_rows(dealt(files), config), path, config)
        return
    watched, seen = gate.watch(files)
    _write(index_rows(dealt(watched), config), path, config, lambda: gate.require(seen))


def update(files: DataFrame, path: str, config: IndexConfig = IndexConfig()) -> None:
    """Bring an index up to date: only new and changed files are chunked, tokenised and
    embedded; rows of unchanged files are copied, those of vanished files go."""
    _write(refresh(files, path, config), path, config)


def open_index(spark: SparkSession, path: str, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Chunks of an index; an index built by other components is refused."""
    manifest = sinks.read_text(spark, f"{path}/manifest.json")
    if manifest is None:
        raise FileNotFoundError(f"no index at {path}")
    theirs, ours = json.loads(manifest), config.index_identity()
    differing = [f"{k}: {theirs.get(k)} != {v}" for k, v in ours.items() if theirs.get(k) != v]
    if differing:
        raise ValueError("index does not match the configuration: " + "; ".join(differing))
    return spark.read.parquet(f"{path}/chunks")


def refresh(files: DataFrame, path: str, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Index rows after a corpus change: unchanged files keep their rows, new or changed
    ones are computed, vanished ones go. ``update`` writes them."""
    spark = files.sparkSession
    stored = open_index(spark, path, config)
    current = fingerprinted(files, config)
    known = stored.select("file", "fingerprint").distinct()
    fresh = index_rows(dealt(history.not_done(current, known, ["file", "fingerprint"]).drop("fingerprint")), config)
    kept = dealt(stored.join(small_side(current.select("file", "fingerprint")), ["file", "fingerprint"], "left_semi"))
    return kept.unionByName(fresh.select(*kept.columns))


def search_at(spark: SparkSession, path: str, questions: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """``search`` on a stored index, with its keyword index and its texts by chunk id."""
    keywords = postings.open_keywords(spark, f"{path}/keywords")
    return search(open_index(spark, path, config), questions, config, keywords, Keyed.open(spark, f"{path}/texts", "chunk_id"))


def search(
    index: DataFrame, questions: DataFrame, config: IndexConfig = IndexConfig(),
    keywords: postings.KeywordIndex | None = None, texts: Keyed | None = None,
) -> DataFrame:
    """Gated chunks per question (``qid, question``), optional ``categories`` per question. Without
    the stored ``keywords`` and ``texts`` the chunks themselves are scanned."""
    tokens = provider("normalizer", config.normalizer)
    embed = provider("embedder", config.embedder, **config.embedder_params)
    score = provider("reranker", config.reranker)
    asked = questions.withColumn("tokens", tokens(F.col("question"))).withColumn("vector", embed(F.col("tokens")))
    filtered = "categories" in questions.columns
    dense = vectors.cosine_search(index, asked.select("qid", "vector", *(["categories"] if filtered else [])), config.dense_top_k)
    if keywords is not None and filtered:
        sparse = postings.filtered_search(keywords, asked, questions.select("qid", "categories"), config.sparse_top_k)
    elif keywords is not None:
        sparse = postings.search(keywords, asked, config.sparse_top_k)
    elif filtered:
        sparse = keyword.filtered_sparse_search(index, asked, questions.select("qid", "categories"), config.sparse_top_k)
    else:
        sparse = keyword.bm25_search(index, asked, config.sparse_top_k)
    pool = max(config.dense_top_k, config.sparse_top_k)
    fused = cut_lineage(fusion.hybrid_candidates(dense, sparse, pool, config.rrf_k))
    rows = questions.count() * pool
    columns = ["file", "page", "category", "text", "tokens"]
    found, _ = fusion.hydrate(fused, index if texts is None else texts, columns, rows)
    scored = found.join(within(asked.select("qid", F.col("tokens").alias("asked")), rows), "qid").withColumn(
        "rerank_score", score(F.col("asked"), F.col("tokens"))
    )
    return fusion.gate(scored, config.gate_threshold, config.top_n).drop("asked", "tokens")
