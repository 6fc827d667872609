"""Documents to chunks: sections, packed sentences, code with its description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import bpe, html as hx, markdown as mx, text as tx
from quillspark.functions.arrow import bound_batches
from quillspark.functions.markdown import pack


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ordinal, number, title, content, start_line, path, hashes)."""
    return docs.select(key, F.posexplode(mx.rows_udf(mx.sections, mx.SECTION)(F.col(text))).alias("ordinal", "s")).select(key, "ordinal", "s.*")


def packed(docs: DataFrame, key: str, text: str = "text", most: int = 500, vocabulary: bpe.Vocabulary | None = None) -> DataFrame:
    """(key, ordinal, chunk, n_tokens, section_id): greedy packing of sentences in the row.

    Tokens are words and marks, counted natively, or those of a vocabulary; then ``n_tokens`` is the sum of a chunk's sentences.
    """
    sentence = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    if vocabulary is None:
        rows = docs.select(key, F.posexplode(pack(sentence, tx.token_count, most)).alias("ordinal", "chunk"))
        return rows.select(key, "ordinal", "chunk", tx.token_count(F.col("chunk")).alias("n_tokens"), F.sha2("chunk", 256).alias("section_id"))
    bound_batches(docs.sparkSession)
    counted = docs.select(key, sentence.alias("s")).withColumn("n", bpe.counts(F.col("s"), vocabulary))
    chunks = pack(F.arrays_zip("s", "n"), lambda x: F.coalesce(x["n"], F.lit(0)), most, lambda x: x["s"], counted=True)
    rows = counted.select(key, F.posexplode(chunks).alias("ordinal", "c"))
    return rows.select(key, "ordinal", "c.chunk", F.col("c.n").alias("n_tokens"), F.sha2("c.chunk", 256).alias("section_id"))


def markdown_code(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(mx.rows_udf(mx.markdown_chunks, mx.CHUNK)(F.col(text))).alias("ordinal", "c")).select(key, "ordinal", "c.*")


def rst_code(docs: DataFrame, key: str, text: str = "text", most: int | None = 50 * 1024) -> DataFrame:
    """Code of reStructuredText; texts over ``most`` bytes have none, with None all are read."""
    return docs.select(key, F.posexplode(mx.rows_udf(lambda t: mx.rst_blocks(t, most), mx.RST)(F.col(text))).alias("ordinal", "c")).select(key, "ordinal", "c.*")


def html_code(docs: DataFrame, key: str, selectors, html: str = "html") -> DataFrame:
    """Selected elements with the headings before them, as Markdown, to code chunks."""

    def to_markdown(page):
        root = hx.parse(page or "")
        order = {id(x): i for i, x in enumerate(root.walk())}
        heads = [(order[id(x)], int(x.tag[1]), x.text()) for x in root.walk() if len(x.tag) == 2 and x.tag[0] == "h" and x.tag[1] in "123456"]
        out = []
        for selector in selectors:
            for n, x in enumerate(hx.select(root, selector)):
                lines = ["#" * level + " " + title for at, level, title in heads if at < order[id(x)]]
                code = x.tag == "pre"
                body = "".join(x.strings()).strip("\n") if code else x.text()
                lines += [f"```{hx._language(x) or ''}", body, "```"] if code else [body]
                out += [c | {"file_path": f"selector: {selector} [{n}]"} for c in mx.markdown_chunks("\n\n".join(lines[:-3]) + "\n" + "\n".join(lines[-3:]) if code else "\n\n".join(lines))]
        return out

    return docs.select(key, F.posexplode(mx.rows_udf(to_markdown, mx.CHUNK)(F.col(html))).alias("ordinal", "c")).select(key, "ordinal", "c.*")


def elements(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Typed elements of converted documents, with page and section."""
    return docs.select(key, F.posexplode(mx.rows_udf(mx.elements, mx.ELEMENT)(F.col(text))).alias("ordinal", "e")).select(key, "ordinal", "e.*")


def content_map(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One struct for each file, typed by its suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin("md", "markdown", "rst", "txt"), "document").when(suffix.isin("html", "htm"), "html").when(suffix == "ipynb", "notebook").when(suffix.isin("json", "xml", "csv"), "data").otherwise("code")
    return files.select(F.struct(F.col(path).alias("file_path"), F.col(content).alias("content"), kind.alias("type"), F.create_map(F.lit("suffix"), suffix).alias("metadata"), F.when(kind == "code", suffix).alias("language")).alias("item"))


def with_missing(found: DataFrame, extra: DataFrame, on: str = "section_id") -> DataFrame:
    """The union of two extractors' blocks: the second's only where the first has none equal."""
    return found.unionByName(extra.join(found.select(on), on, "left_anti"), allowMissingColumns=True)
