"""Vector store: Parquet files by version under a commit log, with add, get, similar, index search, rebuild and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.operators.ivf import IVFIndex
from routelens.operators.versioned import VersionedTable

SCHEMA = "id string, folder string, embedding array<double>, metadata map<string,string>"


class VectorStore:
    """Vectors under string ids, as a ``VersionedTable``: a later version of an id replaces earlier ones, several writers may
    add at a time, and rows are only ever appended. ``path`` must be a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = VersionedTable(spark, self.path, SCHEMA, ("id",))
        self.index: IVFIndex | None = None

    def add(self, rows: DataFrame) -> int:
        """Append id and embedding, with folder and metadata where given, and return the version. Null and empty vectors, and
        those with null or non-finite components, are left out; of rows that repeat an id in one call one stays."""
        has = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        fine = F.col("id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        new = rows.select(F.col("id").cast("string").alias("id"), has("folder", "string").alias("folder"), F.col("embedding").cast("array<double>").alias("embedding"), has("metadata", "map<string,string>").alias("metadata")).where(fine)
        new = new.groupBy("id").agg(F.min_by(F.struct("folder", "embedding", "metadata"), "embedding").alias("x")).select("id", "x.*")
        return self.table.append(new)

    def vectors(self) -> DataFrame:
        """id, folder, embedding, metadata: the latest version of each id."""
        return self.table.latest()

    def get(self, ids: list[str]) -> DataFrame:
        return self.vectors().where(F.col("id").isin(*ids) if ids else F.lit(False))

    def similar(self, query: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
        """The k nearest by a scan: id, dist, by cosine distance, squared Euclidean distance (l2) or negative inner product
        (ip); ties go to the smaller id. Vectors of another length take no part; zero vectors are at cosine distance 1."""
        given = F.array(*(F.lit(float(x)) for x in query))
        total = lambda column: F.aggregate(column, F.lit(0.0), lambda s, x: s + x)
        dot = total(F.zip_with("embedding", given, lambda x, y: x * y))
        norms = F.sqrt(total(F.transform("embedding", lambda x: x * x)) * F.lit(float(sum(x * x for x in query))))
        dist = {"cosine": F.when(norms > 0, 1 - dot / norms).otherwise(1.0), "l2": total(F.zip_with("embedding", given, lambda x, y: (x - y) * (x - y))), "ip": -dot}[metric]
        return self.vectors().where(F.size("embedding") == len(query)).select("id", dist.alias("dist")).orderBy("dist", "id").limit(k)

    def similar_to(self, id: str, k: int = 10, metric: str = "cosine") -> DataFrame:
        """The k nearest to a stored vector, itself left out; nothing for an unknown id."""
        found = self.get([id]).select("embedding").first()
        if found is None:
            return self.spark.createDataFrame([], "id string, dist double")
        return self.similar(found[0], k + 1, metric).where(F.col("id") != id).limit(k)

    def build_index(self, kind: str = "ivf_pq", metric: str = "cosine", **options) -> IVFIndex:
        """Index the present vectors beside the store, in a folder of the last version, and search by it from now on."""
        last = max(self.table.versions(), default=0)
        self.index = IVFIndex.build(self.vectors(), f"{self.path}/index/{last}-{kind}-{metric}", kind, metric, **options)
        return self.index

    def open_index(self, kind: str = "ivf_pq", metric: str = "cosine") -> IVFIndex:
        """The index that was built last, of whatever version."""
        found = max(int(x.split("-")[0]) for x in self.table.names("index") if x.endswith(f"-{kind}-{metric}"))
        self.index = IVFIndex(self.spark, f"{self.path}/index/{found}-{kind}-{metric}")
        return self.index

    def search(self, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        """Per query its k nearest by the index: query_id, rank, id, dist (see ``IVFIndex.search``). Vectors added after the
        index was built aren't found until it is built again."""
        return (self.index or self.open_index()).search(queries, k, **options)

    def rebuild(self, path: str) -> "VectorStore":
        """A store at ``path`` with the latest versions alone, as its first version, dealt by id."""
        store = VectorStore(self.spark, path)
        if store.table.names("log"):
            raise ValueError("the folder holds a store already")
        store.table.append(self.vectors().repartition("id"))
        return store

    def statistics(self) -> DataFrame:
        """folder, vectors, dims (largest length)."""
        return self.vectors().groupBy("folder").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))
