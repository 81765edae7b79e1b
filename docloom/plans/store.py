"""The corpus on disk: tables in a versioned folder, and a log of commits that name the
versions in force.

A change writes new versions of the tables it touches and then one commit, so readers
see all of a change or nothing. Two writers may work at once: a commit is refused where
another came first; settings and buckets that the other left alone are then committed
upon its state, and others are computed anew from it. Tables are partitioned by a bucket
of document_id: a change rewrites only the buckets of its documents, and lookups by
document read one. Tables and commits lie on any file system that Spark knows; workbooks,
run reports and bundles need a folder that behaves like a local one.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import shutil
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom import schema
from docloom.plans.commits import CommitLog, Folder

SCHEMA_VERSION = 2
TABLES = ["documents", "blocks", "chunks", "entities", "keywords", "edges"]
LOGS = ["status", "embedding_cache"]
SEGMENT_PARTS, TOMBSTONE_PARTS = ["forward", "postings", "bounds", "vectors"], ["chunks", "terms"]


def bucket(document_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def upsert(current: DataFrame | None, new: DataFrame, key: str = "document_id") -> DataFrame:
    """current without the documents of new, and new."""
    if current is None:
        return new
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*current.columns) if set(current.columns) <= set(new.columns) else new, allowMissingColumns=True)


def delete(current: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return current.join(ids.select(key), key, "left_anti")


class FrozenCorpus(RuntimeError):
    """The corpus is frozen and takes no changes."""


class Store:
    """Tables of one corpus below ``root`` (a folder that the driver and the executors share)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.folder = Folder(spark, root)
        self.folder.make()
        self.root = Path("/" + self.folder.uri.removeprefix("file:").lstrip("/") if self.folder.uri.startswith("file:") else root)
        self.commits = CommitLog(Folder(spark, f"{self.folder.uri}/commits"), {"schema_version": SCHEMA_VERSION, "tables": {}, "settings": {}, "frozen": False})

    # -------------------------------------------------------------- commits

    @property
    def manifest(self) -> dict:
        return self.commits.latest()[1]

    def setting(self, key: str, default=None):
        return self.manifest["settings"].get(key, default)

    def set_setting(self, key: str, value) -> None:
        self.set_settings({key: value})

    def set_settings(self, values: dict) -> None:
        """All of them in one step."""
        self.commits.update(lambda m: m | {"settings": m["settings"] | values})

    def index_parts(self) -> dict[str, list[str]]:
        """The folders of the index in force, below the corpus, and the tables in each."""
        state = self.setting("index.state") or {"segments": [], "deletes": []}
        return {f"index/{s['id']}": SEGMENT_PARTS for s in state["segments"]} | {f"index/{d}": TOMBSTONE_PARTS for d in state["deletes"]}

    # --------------------------------------------------------------- tables

    def table(self, name: str) -> DataFrame | None:
        m = self.manifest
        parts = m["tables"].get(name)
        if not parts:
            kind = m.get("schemas", {}).get(name)
            return self.spark.createDataFrame([], StructType.fromJson(kind)) if kind else None
        return self._read(name, parts)

    def _read(self, name: str, parts: dict[str, str]) -> DataFrame:
        uri = self.folder.uri
        return self.spark.read.option("basePath", f"{uri}/{name}").parquet(*[f"{uri}/{p}" for p in parts.values()]).drop("bucket", "version")

    def write(self, changes: dict[str, DataFrame], deleted: DataFrame | None = None) -> None:
        """Replace the documents of ``changes`` in all tables (those of ``deleted``
        too) in one step; buckets without such documents keep their files."""
        gone = [df.select("document_id") for df in changes.values() if "document_id" in df.columns] + ([deleted.select("document_id")] if deleted is not None else [])
        ids = gone[0]
        for g in gone[1:]:
            ids = ids.union(g)
        ids = ids.distinct()
        touched = {str(r[0]) for r in ids.select(bucket(F.col("document_id"), self.buckets)).distinct().collect()}  # at most the buckets
        names = [*TABLES, *(n for n in changes if n not in TABLES)]
        of = lambda m, name: {b: p for b, p in m["tables"].get(name, {}).items() if b in touched}
        base: dict | None = None  # the buckets that ``made`` was computed from
        made: dict[str, dict[str, str]] = {}
        kinds: dict[str, dict] = {}

        def change(m: dict) -> dict:
            nonlocal base, made, kinds
            if m["frozen"]:
                raise FrozenCorpus(f"{self.folder.uri} is frozen")
            now = {name: of(m, name) for name in names}
            if base != now:  # the first try, or another writer has changed these buckets
                base, made, kinds = now, {}, {}
                for name in names:
                    if (df := self._replaced(name, now[name], changes.get(name), ids)) is not None:
                        made[name], kinds[name] = self._put(name, df), df.schema.jsonValue()
            tables = {name: {b: p for b, p in m["tables"].get(name, {}).items() if b not in touched} | made.get(name, {}) for name in {*m["tables"], *made}}
            return m | {"tables": tables, "schemas": m.get("schemas", {}) | kinds}

        self.commits.update(change)

    def _replaced(self, name: str, parts: dict[str, str], new: DataFrame | None, ids: DataFrame) -> DataFrame | None:
        """What some buckets of a table hold after a change; None if nothing was or comes there."""
        if not parts:
            return new
        left = self._read(name, parts).join(ids, "document_id", "left_anti")
        return left if new is None else left.unionByName(new, allowMissingColumns=True)

    def _put(self, name: str, df: DataFrame) -> dict[str, str]:
        """Write a version; the path of each of its buckets."""
        version = f"{name}/version={uuid.uuid4().hex[:12]}"
        df.withColumn("bucket", bucket(F.col("document_id"), self.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder.uri}/{version}")
        return {n.removeprefix("bucket="): f"{version}/{n}" for n in self.folder.names(version) if n.startswith("bucket=")}

    def delete(self, ids: DataFrame) -> None:
        self.write({}, ids)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a log or cache, which documents' changes leave alone."""
        rows.write.mode("append").parquet(f"{self.folder.uri}/{name}")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.uri}/{name}")

    def reset(self) -> None:
        """Empty all tables and index settings; the status log and embedding cache stay."""
        self.commits.update(lambda m: m | {"tables": {}, "schemas": {}, "settings": {k: v for k, v in m["settings"].items() if not k.startswith("index.")}, "frozen": False})
        self.vacuum()

    def vacuum(self) -> None:
        """Remove files that no table in force names."""
        used = {p.rsplit("/", 1)[0] for parts in self.manifest["tables"].values() for p in parts.values()} | set(self.index_parts())
        for folder in (*TABLES, "index/segments", "index/deletes"):
            for name in self.folder.names(folder):
                if f"{folder}/{name}" not in used:
                    self.folder.remove(f"{folder}/{name}")
        self.commits.vacuum()

    # ------------------------------------------------------------- artifacts

    def write_workbooks(self, tables: DataFrame) -> int:
        """A workbook below the corpus for each row of tables (table_file, rows),
        written where the rows lie; each appears whole, by a rename. Returns their number."""
        root = str(self.root)

        def write(batches):
            for b in batches:
                for file, rows in zip(b.table_file, b["rows"], strict=True):
                    out = Path(root) / file
                    out.parent.mkdir(parents=True, exist_ok=True)
                    mine = out.with_name(f".{uuid.uuid4().hex}")
                    write_workbook([list(r) for r in rows], str(mine))
                    os.replace(mine, out)
                yield b[["table_file"]]

        return tables.select("table_file", "rows").mapInPandas(write, "table_file string").count()

    def save_parsed(self, blocks: DataFrame, run_id: str) -> None:
        """One JSON object a document, a line each: document_id and its blocks in reading order."""
        block = F.struct("reading_order", *[c for c in blocks.columns if c not in ("document_id", "reading_order")])
        blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.to_json(block))).alias("blocks")).write.json(str(self.root / "parsed" / run_id))

    def write_run(self, run_id: str, report: dict) -> str:
        """The run's manifest: what was asked, what came of it."""
        out = self.root / "runs" / f"{run_id}.json"
        out.parent.mkdir(exist_ok=True)
        out.write_text(json.dumps(report, ensure_ascii=False, indent=1, default=str))
        return str(out)

    # --------------------------------------------------------------- corpus

    def stats(self) -> dict[str, int]:
        return {n: (t.count() if (t := self.table(n)) is not None else 0) for n in ("documents", "blocks", "chunks", "edges")}

    def freeze(self, contract: dict) -> dict:
        """Fix the corpus; from now on it takes no changes. contract: the embedding model and other settings that a reader must share."""
        stats = self.stats()
        if not stats["chunks"]:
            raise ValueError("a corpus without chunks can't be frozen")
        corpus: dict = {}

        def change(m: dict) -> dict:
            corpus_id = hashlib.sha1(json.dumps([stats, contract, sorted(str(v) for v in m["tables"].values())], sort_keys=True).encode()).hexdigest()[:20]
            corpus.update(id=corpus_id, stats=stats, contract=contract, created_at=dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"))
            return m | {"frozen": True, "corpus": corpus}

        self.commits.update(change)
        return corpus

    def validate(self, contract: dict | None = None) -> list[str]:
        """What is wrong with a frozen corpus: nothing, if it is sound."""
        m, wrong = self.manifest, []
        if m["schema_version"] != SCHEMA_VERSION:
            wrong.append(f"schema version {m['schema_version']} instead of {SCHEMA_VERSION}")
        if not m["frozen"] or "corpus" not in m:
            return [*wrong, "not frozen"]
        wrong += [f"missing {p}" for parts in m["tables"].values() for p in parts.values() if not self.folder.exists(p)]
        wrong += [f"missing {folder}/{p}" for folder, parts in self.index_parts().items() for p in parts if not self.folder.exists(f"{folder}/{p}/_SUCCESS")]
        if not wrong and (now := self.stats()) != m["corpus"]["stats"]:
            wrong.append(f"row counts {now} instead of {m['corpus']['stats']}")
        for k, v in (contract or {}).items():
            if m["corpus"]["contract"].get(k) != v:
                wrong.append(f"{k} is {m['corpus']['contract'].get(k)!r} instead of {v!r}")
        return wrong

    # --------------------------------------------------------------- bundle

    def export(self, target: str) -> str:
        """A ZIP of the frozen corpus (tables, index, logs, workbooks) with an inventory
        of SHA-256 sums; outside of the corpus folder."""
        if wrong := self.validate():
            raise ValueError("; ".join(wrong))
        out = Path(target).resolve()
        if out.is_relative_to(self.root.resolve()):
            raise ValueError("the bundle must lie outside of the corpus")
        m = self.manifest
        used = [f for parts in m["tables"].values() for p in parts.values() for f in sorted((self.root / p).rglob("*.parquet"))]
        folders = [*LOGS, "tables", *self.index_parts()]
        beside = [f for d in folders for f in sorted((self.root / d).rglob("*")) if f.is_file() and not f.name.endswith(".crc")]
        last = self.root / "commits" / f"{self.commits.latest()[0]:020d}.json"
        files = [last, *used, *beside]
        inventory = {str(f.relative_to(self.root)): _sha256(f) for f in files}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, str(f.relative_to(self.root)))
            z.writestr("inventory.json", json.dumps(inventory))
        return str(out)

    @classmethod
    def restore(cls, spark: SparkSession, bundle: str, root: str, max_files: int = 1_000_000, max_mb: int = 1_000_000) -> Store:
        """Unpack a bundle beside ``root``, check paths, inventory and sums, and only then put it in place."""
        staging, target = Path(f"{root}.{uuid.uuid4().hex}"), Path(root)
        try:
            with zipfile.ZipFile(bundle) as z:
                entries = z.infolist()
                if len(entries) > max_files or sum(i.file_size for i in entries) > max_mb * 2**20:
                    raise ValueError("the bundle is too large")
                for i in entries:
                    if not (staging / i.filename).resolve().is_relative_to(staging.resolve()):
                        raise ValueError(f"unsafe path {i.filename}")
                z.extractall(staging)
            inventory = json.loads((staging / "inventory.json").read_text())
            there = {str(f.relative_to(staging)) for f in staging.rglob("*") if f.is_file()} - {"inventory.json"}
            if there != set(inventory):
                raise ValueError(f"files differ from the inventory: {sorted(there ^ set(inventory))[:5]}")
            if bad := [n for n, s in inventory.items() if _sha256(staging / n) != s]:
                raise ValueError(f"wrong sums: {bad[:5]}")
            (staging / "inventory.json").unlink()
            old = Path(f"{root}.{uuid.uuid4().hex}") if target.exists() else None
            if old:
                os.replace(target, old)
            try:
                os.replace(staging, target)
                store = cls(spark, root)
                if wrong := store.validate():
                    raise ValueError("; ".join(wrong))
            except Exception:
                if target.exists() and old:
                    shutil.rmtree(target)
                if old:
                    os.replace(old, target)
                raise
            if old:
                shutil.rmtree(old)
            return store
        finally:
            if staging.exists():
                shutil.rmtree(staging)


def _sha256(file: Path) -> str:
    h = hashlib.sha256()
    with file.open("rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


def inventory_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (path, sum) of only one of two inventories, with side 'left' or 'right'."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def long_tables(blocks: DataFrame) -> DataFrame:
    """(block_id, row, col, header, value) of table and kpi blocks with a body: rows
    cut or filled to the header's width, headers made unique."""
    from docloom.functions import text as T

    b = blocks.where("block_type in ('table', 'kpi')").where(F.size("rows") > 1).withColumn("head", T.unique_headers(F.col("rows")[0]))
    r = b.select("block_id", "head", F.posexplode(F.slice("rows", 2, F.size("rows") - 1)).alias("row", "values"))
    return r.select("block_id", "row", "values", F.posexplode("head").alias("col", "header")).select("block_id", "row", "col", "header", F.coalesce(F.get("values", F.col("col")), F.lit("")).alias("value"))


def write_workbook(rows: list[list[str]], path: str) -> None:
    """A sheet of inline strings; a text that starts with = stays a text."""
    from xml.sax.saxutils import escape

    lines = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(c))}</t></is></c>' for c in r) + "</row>" for r in rows)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Table" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')


STATUS_SCHEMA = schema.STATUS
