"""Labelled data sets and documents from files, with columns found by name."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.operators import segments

TEXT_NAMES = "text prompt input content question instruction user_input query sentence message".split()
LABEL_NAMES = "label labels is_injection injection malicious target class category is_malicious toxic jailbreak y".split()
SUFFIXES = (".jsonl", ".json", ".csv", ".tsv", ".parquet")
#: Public data sets by name: where a hub keeps them, and the splits to fetch.
REGISTRY: dict[str, tuple[str, tuple[str, ...]]] = {"jayavibhav": ("jayavibhav/prompt-injection", ("train",)), "promptshield": ("hendzh/PromptShield", ("train", "validation", "test"))}
#: Data sets that are left out, and why.
EXCLUDED: dict[str, tuple[str, str]] = {"deepset": ("deepset/prompt-injections", "its rows are all in another set of the registry")}
TEXT_SUFFIXES = (".txt", ".md", ".csv", ".json", ".yaml", ".yml", ".log")
DOCUMENT = "body string, metadata_text array<string>, metadata map<string,string>, page_count int, flags array<string>, error string"
PDF_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")


class DatasetError(ValueError):
    """A data set that cannot be read or understood."""


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file, by its suffix; JSON may be an array or an object with `data`."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".jsonl":
        df = spark.read.json(path)
    elif suffix == ".json":
        df = spark.read.option("multiLine", True).json(path)
        if df.columns == ["data"] or ("data" in df.columns and df.schema["data"].dataType.typeName() == "array"):
            df = df.select(F.explode("data").alias("d")).select("d.*")
    elif suffix in (".csv", ".tsv"):
        df = spark.read.csv(path, header=True, sep="\t" if suffix == ".tsv" else ",", multiLine=True, quote='"', escape='"')
    elif suffix == ".parquet":
        df = spark.read.parquet(path)
    else:
        raise DatasetError(f"{path}: one of {', '.join(SUFFIXES)} is needed")
    if df.isEmpty():
        raise DatasetError(f"{path} has no rows")
    return df


def find_column(columns: list[str], names: list[str]) -> str | None:
    """The first of `names`, in their order, that is a column in whatever case."""
    have = {}
    for c in columns:
        have.setdefault(c.lower().strip(), c)
    return next((have[n] for n in names if n in have), None)


def label_column(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType.typeName(), df["`" + name + "`"]
    if kind == "boolean":
        return c.cast("int")
    return T.label_of(c) if kind == "string" else T.number_label(c)


def normalised(df: DataFrame, dataset: str, source_tag: str = "user_input", text: str | None = None, label: str | None = None, invert_labels: bool = False) -> DataFrame:
    """Any labelled rows as samples; rows without a text or with an unknown label are left out."""
    text = text or find_column(df.columns, TEXT_NAMES)
    label = label or find_column(df.columns, LABEL_NAMES)
    if text is None or label is None:
        raise DatasetError(f"{dataset}: no {'text' if text is None else 'label'} column among {df.columns}")
    if df.schema[text].dataType.typeName() != "string":
        raise DatasetError(f"{dataset}: {text} is no text column")
    attack = find_column(df.columns, ["attack_type", "type"])
    y = label_column(df, label)
    rows = df.select(
        F.monotonically_increasing_id().alias("ord"),
        F.lit(dataset).alias("dataset"),
        df["`" + text + "`"].alias("text"),
        (1 - y if invert_labels else y).cast("int").alias("label"),
        F.lit(source_tag).alias("source_tag"),
        (df["`" + attack + "`"].cast("string") if attack else F.lit(None).cast("string")).alias("attack_type"),
    )
    return rows.where(F.col("text").rlike(T.NONBLANK) & F.col("label").isNotNull())


def load_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file's samples, under the file's name; an error if none can be used."""
    df = normalised(read_rows(spark, path), os.path.splitext(os.path.basename(path))[0], **options)
    if df.isEmpty():
        raise DatasetError(f"{path} has no usable row")
    return df


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any file system that Spark reads, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def hub_loader(hub_id: str, split: str) -> pd.DataFrame:
    """A split of a hub's data set; needs a network and the hub's library."""
    try:
        from datasets import load_dataset
    except ImportError as e:
        raise DatasetError("the hub's library is not installed; give fetch() a loader, or put the files there by hand") from e
    return load_dataset(hub_id, split=split).to_pandas()


def fetch(spark: SparkSession, path: str, *names: str, loader: Callable[[str, str], pd.DataFrame | DataFrame] = hub_loader) -> dict[str, str]:
    """Data sets of the registry (all, if none is named) as CSV folders below a path, one for each split: what became of each.

    A split that is there already is left as it is; one that can't be loaded does not keep others from it.
    """
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise DatasetError(f"no data set {unknown[0]!r}" + (f": {EXCLUDED[unknown[0]][1]}" if unknown[0] in EXCLUDED else f" among {', '.join(REGISTRY)}"))
    out = {}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names or REGISTRY:
        hub_id, splits = REGISTRY[name]
        for split in splits:
            label = f"{name}_{split}" if len(splits) > 1 else name
            target = f"{path.rstrip('/')}/{label}.csv"
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target)):
                out[label] = "present"
                continue
            try:
                got = loader(hub_id, split)
                (got if isinstance(got, DataFrame) else spark.createDataFrame(got)).write.csv(target, header=True, quoteAll=True, escape='"')
                out[label] = "fetched"
            except Exception as e:  # whatever a hub says
                out[label] = f"failed: {str(e)[:200]}"
    return out


def load_directory(spark: SparkSession, path: str, **options) -> DataFrame:
    """The samples of all files in a folder, in order of their paths; a bad file is a warning."""
    parts = []
    for k, name in enumerate(listed(spark, path)):
        if os.path.splitext(name)[1].lower() in SUFFIXES:
            try:
                parts.append(load_file(spark, f"{path.rstrip('/')}/{name}", **options).withColumn("ord", F.col("ord") + (k << 50)))
            except Exception as e:  # whatever a reader says of a bad file
                warnings.warn(f"{name}: {str(e)[:300]}", stacklevel=2)
    if not parts:
        raise DatasetError(f"{path} has no usable file")
    return reduce(DataFrame.unionByName, parts)


def write_csv(samples: DataFrame, path: str) -> None:
    """text and label, in a folder for each data set."""
    samples.select("text", "label", "dataset").write.mode("overwrite").partitionBy("dataset").csv(path, header=True, quoteAll=True, escape='"')


def extracted(path: str, content: bytes, mime: str | None = None, max_pages: int | None = None) -> dict:
    """DOCUMENT of one file by its MIME type or name: PDF if a reader is installed, text with bad bytes replaced, else an error."""
    name, kind = path.lower(), (mime or "").lower()
    if "pdf" in kind or name.endswith(".pdf"):
        try:
            import pdfplumber
        except ImportError:
            return {"error": "no PDF reader is installed"}
        import io

        try:
            with pdfplumber.open(io.BytesIO(content)) as pdf:
                meta = {k: str(v) for k, v in (pdf.metadata or {}).items() if k in PDF_KEYS and str(v).strip()}
                body = "\n".join(p.extract_text() or "" for p in pdf.pages[:max_pages]).strip()
                return {"body": body, "metadata": meta, "metadata_text": [f"{k}: {meta[k]}" for k in PDF_KEYS if k in meta], "page_count": len(pdf.pages), "flags": ["file_metadata_extracted"] if meta else []}
        except Exception as e:  # a damaged file must not end the job
            return {"error": f"{type(e).__name__}: {e}"}
    if kind.startswith("text/") or "html" in kind or name.endswith((*TEXT_SUFFIXES, ".html", ".htm")):
        return {"body": content.decode("utf-8", "replace")}
    return {"error": f"unsupported file {os.path.basename(path)}" + (f" of type {mime}" if mime else "")}


def documents_of(files: DataFrame, max_pages: int | None = None) -> DataFrame:
    """path and DOCUMENT of rows (path, content, mime); mime may be null, or no column."""

    def run(batches):
        for pdf in batches:
            kinds = pdf["mime"] if "mime" in pdf else [None] * len(pdf)
            rows = [{"path": p, "metadata_text": [], "metadata": {}, "flags": [], "body": None, "page_count": None, "error": None} | extracted(p, bytes(c), m, max_pages) for p, c, m in zip(pdf["path"], pdf["content"], kinds)]
            yield pd.DataFrame(rows)[["path", *[x.split()[0] for x in DOCUMENT.split(", ")]]]

    return files.select("path", "content", *(["mime"] if "mime" in files.columns else [])).mapInPandas(run, f"path string, {DOCUMENT}")


def read_documents(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """path and DOCUMENT of every file under a path."""
    return documents_of(spark.read.format("binaryFile").load(path), max_pages)


def preprocessed(documents: DataFrame, most: int | None = T.MOST_INSPECTED) -> DataFrame:
    """path, text, variants, flags, script, error of documents: body and metadata normalised piece by piece, and merged.

    The first piece with anything in it gives the text; the others, and what decoding finds, are variants. A file without
    any text has an empty one. The document's own flags come last.
    """
    none = F.array().cast("array<string>")
    pieces = F.filter(F.concat(F.array("body"), F.coalesce("metadata_text", none)), lambda x: x.isNotNull() & x.rlike(T.NONBLANK))
    df = segments.normalised_each(documents.withColumn("_p", pieces), F.col("_p"), most)
    n = F.col("norm")
    rest = F.flatten(F.transform(F.slice(n, 2, 1 << 30), lambda x: F.concat(F.array(x["text"]), x["variants"])))
    first = F.try_element_at(n, F.lit(1))
    return df.select(
        "path",
        F.coalesce(first["text"], F.lit("")).alias("text"),
        F.concat(F.coalesce(first["variants"], none), rest).alias("variants"),
        F.array_distinct(F.concat(F.flatten(n["flags"]), F.coalesce("flags", none))).alias("flags"),
        F.try_element_at(F.filter(n["script"], lambda x: x.isNotNull()), F.lit(1)).alias("script"),
        "error",
    )
