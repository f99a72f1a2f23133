"""Reading order of scanned text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(blocks: DataFrame) -> DataFrame:
    """(job_id, line, text, min_confidence, n_blocks) from blocks(job_id, block_id, text, x0, y0, y1, confidence).

    Blocks by vertical centre join the last line if their centre is within half
    the smaller height of the line's running mean centre (the line's height is
    its running least). The state depends on its own output, so it is a fold
    over a note's sorted blocks, in the JVM; a page bounds the array.
    """
    key = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("x0").cast("double").alias("x"), "block_id", (F.col("y1") - F.col("y0")).cast("double").alias("h"), "text", F.col("confidence").cast("double").alias("c"))
    every = blocks.groupBy("job_id").agg(F.sort_array(F.collect_list(key)).alias("b"))
    start = "cast(array() as array<struct<line:int,x:double,text:string,c:double>>) as out, -1 as line, 0D as cy, 0D as h, 0 as n"
    fold = f"""aggregate(b, (select_state), (s, k) -> if(s.line >= 0 and abs(k.cy - s.cy) <= least(k.h, s.h) / 2,
        named_struct('out', s.out || array(named_struct('line', s.line, 'x', k.x, 'text', k.text, 'c', k.c)), 'line', s.line, 'cy', (s.cy * s.n + k.cy) / (s.n + 1), 'h', least(k.h, s.h), 'n', s.n + 1),
        named_struct('out', s.out || array(named_struct('line', s.line + 1, 'x', k.x, 'text', k.text, 'c', k.c)), 'line', s.line + 1, 'cy', k.cy, 'h', k.h, 'n', 1)), s -> s.out)"""
    state = "named_struct(" + ", ".join(f"'{p.rsplit(' as ', 1)[1]}', {p.rsplit(' as ', 1)[0]}" for p in _parts(start)) + ")"
    x = every.select("job_id", F.explode(F.expr(fold.replace("(select_state)", state))).alias("r"))
    x = x.groupBy("job_id", F.col("r.line").alias("line")).agg(F.sort_array(F.collect_list(F.struct("r.x", "r.text"))).alias("t"), F.min("r.c").alias("min_confidence"), F.count("*").alias("n_blocks"))
    return x.select("job_id", "line", F.array_join("t.text", " ").alias("text"), "min_confidence", "n_blocks")


def _parts(text: str) -> list[str]:
    """Parts of a list between commas outside of brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]
