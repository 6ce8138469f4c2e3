"""Fill-in-middle transformation by a pre-tokenizer's offsets.

A Split pre-tokenizer of the tokenizers library, with isolated matches and no training, cuts a text into tokens
and tells where each begins and ends in code points. The tokens cover the whole text, so the end of the i-th one
is where the first i tokens end: the length of the offset array is n, and two ranked offsets cut the text into
prefix, middle and suffix.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from cloakspark.llm._common import map_batches, table, texts_of

#: A word with the white space before it, or white space at the end of the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100: documents that are transformed, and of these the ones that take the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
FULL = "doc_id long, n long, form string, prefix string, middle string, suffix string, output string"


def ends(text: str, splitter: Split) -> list[int]:
    """Where each token ends, in code points."""
    return [e for _, (_, e) in splitter.pre_tokenize_str(text)] if text else []


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on the id only; a null id draws like the empty string."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def parts(text: str, doc_id: int | None, splitter: Split) -> tuple[int, str, str, str, str]:
    """n, form and, unless the form is plain, prefix, middle and suffix (plain: the whole text as prefix)."""
    at = ends(text, splitter)
    n = len(at)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= RATE:
        return n, "plain", text, "", ""
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    low, high = (at[k - 1] if k else 0 for k in (first, last))
    return n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", text[:low], text[low:high], text[high:]


def written(form: str, prefix: str, middle: str, suffix: str) -> str:
    """The output text of a form."""
    if form == "plain":
        return prefix
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def rebuilt(form: str, output: str) -> str:
    """The text from output and form alone. The marks stand once each in it, and none can arise where parts meet."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def transformed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Every row with its form and parts (see FULL), or with `full=False` their lengths and digests (see SCHEMA).

    Row-local: no shuffle. A null text counts as empty; an empty one is plain, with n = 0. Null ids pass through, and
    rows with equal ids draw alike. Repeated rows stay. Only `id_col` and `text_col` are read, so no other column can
    clash; an empty table gives no rows. Texts of any length are cut whole, in time linear in their length.
    """

    def make():
        splitter = Split(Regex(UNIT), "isolated")
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                n, form, prefix, middle, suffix = parts(text, doc_id, splitter)
                output = written(form, prefix, middle, suffix)
                plain = form == "plain"
                if full:
                    rows.append((doc_id, n, form, prefix, None if plain else middle, None if plain else suffix, output))
                else:
                    rows.append((doc_id, n, form, None if plain else len(prefix), None if plain else len(middle), sha(output), sha(rebuilt(form, output))))
            long, text = pa.int64(), pa.string()
            kinds = [long, long, text, text, text, text, text] if full else [long, long, text, long, long, text, text]
            names = [c.split()[0] for c in (FULL if full else SCHEMA).split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return each

    rows = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return map_batches(rows, make, FULL if full else SCHEMA)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, form, lengths and digests of every whole document."""
    return transformed(table(spark, sf_dir, "documents"), full=False)


QUERIES = {"op13_middle": op13_middle}
ORACLES = {
    "op13_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
d AS (
  SELECT doc_id, text, units, len(units) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS p1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS p2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM t),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(p1, p2)], '') AS pre, array_to_string(units[least(p1, p2) + 1:greatest(p1, p2)], '') AS mid, array_to_string(units[greatest(p1, p2) + 1:], '') AS suf FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
}
