"""Archives and markup that Spark has no reader for: Arrow functions over whole files (``binaryFile``), one file at a time."""

from __future__ import annotations

import csv
import io
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import residues as R

MEMBER_ROWS, CHUNK_ROWS, PASSAGE_WORDS = "path string, member string, ordinal long, fields map<string,string>", 5000, 350
PASSAGE = "path string, chapter string, nbk_id string, section string, ordinal int, kind string, text string, n_words int"


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def zipped_tables(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Rows of all CSV members of zip archives, in member order, as maps; a damaged archive fails the query."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch.path, batch.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if bad := z.testzip():
                        raise ValueError(f"{path_}: {bad} is damaged")
                    for name in sorted(z.namelist()):
                        if not name.endswith(".csv") or (only and not re.search(only, name)):
                            continue
                        with z.open(name) as f:
                            held = []
                            for i, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8"))):
                                held.append((path_, name.rsplit("/", 1)[-1][:-4], i, {k: v for k, v in row.items() if k and v not in ("", None)}))
                                if len(held) == CHUNK_ROWS:
                                    yield pd.DataFrame(held, columns=["path", "member", "ordinal", "fields"])
                                    held = []
                            if held:
                                yield pd.DataFrame(held, columns=["path", "member", "ordinal", "fields"])

    return files(spark, path).mapInPandas(read, MEMBER_ROWS)


def assays(rows: DataFrame) -> DataFrame:
    """Assay rows with one substitution each: assay, change, score, bin and folds. Multiple mutants are left out; a bin that is
    not 0 or 1 is null, and one that says tolerated (1) becomes label 0."""
    f = lambda c: F.col("fields")[c]
    bin_ = f("DMS_score_bin").try_cast("double")
    made = rows.select(F.col("member").alias("assay"), f("mutant").alias("mutant"), R.one_letter_change(f("mutant")).alias("c"), f("mutated_sequence").alias("mutated_sequence"), f("DMS_score").try_cast("double").alias("score"), F.when(bin_.isin(0.0, 1.0), 1 - bin_).alias("label"), *[f(k).try_cast("int").alias(k) for k in ("fold_random_5", "fold_modulo_5", "fold_contiguous_5")], "ordinal")
    return made.filter("c is not null").select("assay", "mutant", "c.*", "mutated_sequence", "score", "label", "fold_random_5", "fold_modulo_5", "fold_contiguous_5", "ordinal")


def model_scores(rows: DataFrame, models: list[str]) -> DataFrame:
    """Zero-shot scores by model, the median of rows with the same key."""
    from evidara.functions.text import model_column

    f = lambda c: F.col("fields")[c]
    each = rows.select(F.col("member").alias("assay"), f("mutant").alias("mutant"), *[f(m).try_cast("double").alias(model_column(m)) for m in models])
    return each.groupBy("assay", "mutant").agg(*[F.median(model_column(m)).alias(model_column(m)) for m in models])


def clinical_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes labelled in words, and each protein's sequence, as two tables."""
    f = lambda c: F.col("fields")[c]
    label = F.when(F.lower(f("DMS_bin_score")) == "pathogenic", 1.0).when(F.lower(f("DMS_bin_score")) == "benign", 0.0)
    made = rows.select(F.col("member").alias("np_accession"), R.one_letter_change(f("mutant")).alias("c"), label.alias("label"), "ordinal").filter("c is not null and label is not null")
    found = rows.filter(f("protein_sequence").isNotNull()).groupBy(F.col("member").alias("np_accession")).agg(F.min_by(f("protein_sequence"), "ordinal").alias("sequence"))
    return made.select("np_accession", "c.*", "label", "ordinal"), found


def texts(element: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(element.itertext())).strip() if element is not None else ""


def article(content: bytes) -> tuple[str, str, str, str]:
    """Title, abstract, body and type of a JATS article."""
    root = ET.fromstring(content)
    front = root.find(".//article-meta")
    body = root.find(".//body")
    paragraphs = [texts(p) for p in body.iter("p")] if body is not None else []
    return texts(front.find(".//article-title") if front is not None else None), texts(front.find(".//abstract") if front is not None else None), "\n".join(p for p in paragraphs if p), root.get("article-type", "")


def articles(spark: SparkSession, path: str, metadata: DataFrame, licences: list[str], least: int = 200) -> DataFrame:
    """Full-text articles whose licence allows it, that are not retracted and long enough; ``metadata``: pmcid, licence, retracted."""
    from evidara.functions.clinical import licence_code

    @F.pandas_udf("struct<title:string,abstract:string,body:string,article_type:string>")
    def parse(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(c) for c in content], columns=["title", "abstract", "body", "article_type"])

    keyed = files(spark, path, "*.xml").withColumn("pmcid", F.regexp_extract("path", r"(PMC\d+)", 1))
    allowed = metadata.filter(licence_code(F.col("licence")).isin(*licences) & ~F.coalesce("retracted", F.lit(False)))
    rows = keyed.join(allowed.select("pmcid", "licence"), "pmcid").select("pmcid", "licence", parse("content").alias("a")).select("pmcid", "licence", "a.*")
    return rows.filter(F.length("body") >= least)


def grid(rows: list[ET.Element]) -> list[list[str]]:
    """Cells of a table laid out with their row and column spans."""
    out: list[list[str]] = []
    hanging: dict[int, tuple[int, str]] = {}
    for row in rows:
        line: list[str] = []

        def fill() -> None:
            while len(line) in hanging and hanging[len(line)][0] > 0:
                left, text = hanging[len(line)]
                hanging[len(line)] = (left - 1, text)
                line.append(text)

        for cell in row:
            fill()
            text = texts(cell)
            for _ in range(int(cell.get("colspan", 1))):
                hanging[len(line)] = (int(cell.get("rowspan", 1)) - 1, text)
                line.append(text)
        fill()
        out.append(line)
    return out


def passages(title: str, root: ET.Element, most: int = PASSAGE_WORDS) -> Iterator[tuple[str, str, str]]:
    """(section, kind, text) of a chapter: paragraphs of one section gathered up to ``most`` words, table rows with their headers;
    references are left out."""

    def cut(words: list[str]) -> Iterator[str]:
        for i in range(0, len(words), most):
            yield " ".join(words[i : i + most])

    def walk(section: ET.Element, name: str) -> Iterator[tuple[str, str, str]]:
        held: list[str] = []
        for part in section:
            if part.tag in ("ref-list", "title"):
                continue
            if part.tag == "sec":
                for text in cut(held):
                    yield name, "text", text
                held = []
                yield from walk(part, f"{name} > {texts(part.find('title'))}" if name else texts(part.find("title")))
            elif part.tag in ("table-wrap", "table"):
                head = grid(list(part.iter("thead"))[0].findall("tr")) if list(part.iter("thead")) else []
                bodies = list(part.iter("tbody"))
                for row in grid(bodies[0].findall("tr")) if bodies else []:
                    names = head[-1] if head else [""] * len(row)
                    yield name, "table", "; ".join(f"{h}: {c}" if h else c for h, c in zip(names, row, strict=False) if c)
            else:
                new = texts(part).split()
                if held and len(held) + len(new) > most:
                    yield name, "text", " ".join(held)
                    held = []
                held += new
        for text in cut(held):
            yield name, "text", text

    yield from walk(root, title)


def chapters(spark: SparkSession, path: str) -> DataFrame:
    """Passages of the chapters in folders or tar archives of XML; members that are not chapters are skipped."""

    def members(path_: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        if re.search(r"\.(tar|tgz|tar\.gz)$", path_):
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for m in t:
                    if m.isfile() and m.name.endswith((".nxml", ".xml")):
                        yield m.name, t.extractfile(m).read()
        else:
            yield path_, content

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch.path, batch.content, strict=True):
                for name, data in members(path_, content):
                    root = ET.fromstring(data)
                    body = root.find(".//book-part/body")
                    if body is None:
                        continue
                    title = texts(root.find(".//book-part-meta//title"))
                    nbk = texts(root.find(".//book-part-id")) or (root.find(".//book-part").get("id") or "")
                    rows = [(name, title, nbk, s, i, k, t, len(t.split())) for i, (s, k, t) in enumerate(passages(title, body)) if t]
                    yield pd.DataFrame(rows, columns=["path", "chapter", "nbk_id", "section", "ordinal", "kind", "text", "n_words"])

    return files(spark, path).mapInPandas(read, PASSAGE)


def chapter_ids(spark: SparkSession, path: str) -> DataFrame:
    """A table whose lines are UTF-8 or else Windows-1252: short name, title, chapter and publication number."""

    @F.pandas_udf("array<string>")
    def decode(content: pd.Series) -> pd.Series:
        def line(raw: bytes) -> str:
            try:
                return raw.decode()
            except UnicodeDecodeError:
                return raw.decode("cp1252", "replace")

        return content.map(lambda c: [line(x) for x in c.splitlines()])

    cells = F.split("line", "\t")
    rows = files(spark, path).select(F.explode(decode("content")).alias("line")).filter(~F.col("line").startswith("#") & (F.size(cells) >= 4))
    return rows.select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(("short_name", "title", "nbk_id", "pmid"))])
