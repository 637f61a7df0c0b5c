"""Queries that write and read payloads, each with the SQL of what they must give."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from jumpmark import adapters as A
from jumpmark.functions import bits
from jumpmark.operators import codec, costs, description
from jumpmark.plans import choices, oracles
from jumpmark.plans.blocks import ORACLE_SQL, query
from jumpmark.plans.catalog import block_table, rounded
from jumpmark.plans.oracles import _CC, _EV, _FEAT, _least

__all__ = ["ORACLE_SQL"]


@query("WITH x AS (SELECT p_partkey, p_partkey % 5000 + 1 AS n FROM part) SELECT p_partkey, (16 + 2 * (length(bin(n)) - 1) + 1 + length(bin(n)) - 1 + 2 * (length(bin(length(bin(n)))) - 1) + 1 + 2 * (length(bin(p_partkey % 7 + 1)) - 1) + 1 + 8 * (p_partkey % 7 + 1))::BIGINT AS n_bits, true AS same FROM x")
def bit_round_trips(spark, sf):
    """A number in 16 bits, as gamma and delta code, and a palette, written and read again."""

    def run(batches):
        for pdf in batches:
            out = []
            for key in pdf["p_partkey"]:
                n, colors = key % 5000 + 1, [(key * k) % 256 for k in range(key % 7 + 1)]
                w = bits.BitWriter().number(n, 16).gamma(n).delta(n)
                bits.write_palette(w, colors)
                r = bits.BitReader(w.bytes())
                out.append((key, w.size, (r.number(16), r.gamma(), r.delta(), bits.read_palette(r)) == (n, n, n, colors)))
            yield pd.DataFrame(out, columns=["p_partkey", "n_bits", "same"])

    return A.table(spark, sf, "part").select("p_partkey").mapInPandas(run, "p_partkey long, n_bits long, same boolean")


@query(f"WITH {_EV}, c AS (SELECT block_id, mark, count(*) AS n FROM ev GROUP BY ALL) SELECT block_id, sum(n)::BIGINT AS n, 16 + 16 * count(*)::BIGINT AS dictionary_bits, true AS same, true AS prefix_free FROM c GROUP BY block_id")
def huffman_round_trip(spark, sf):
    """Marks of a block by a Huffman code with its dictionary, read again."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = pdf.sort_values(["t", "seq"])["mark"].astype(int).tolist()
        w = bits.BitWriter()
        codes = bits.write_huffman(w, marks)
        head = w.size
        for c in marks:
            w.raw(codes[c])
        r = bits.BitReader(w.bytes())
        back = bits.read_huffman(r)
        free = not any(a != b and b.startswith(a) for a in back for b in back)
        return pd.DataFrame([(pdf["block_id"].iloc[0], len(marks), head, [bits.read_symbol(r, back) for _ in marks] == marks, free)], columns=["block_id", "n", "dictionary_bits", "same", "prefix_free"])

    return A.pp_events(spark, sf).select("block_id", "t", "seq", "mark").groupBy("block_id").applyInPandas(one, "block_id long, n long, dictionary_bits long, same boolean, prefix_free boolean")


@query(f"WITH {_CC}, lo AS (SELECT * FROM jo QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY cost, ord) = 1) SELECT ev.block_id, split_part(pair, '+', 1) AS form, split_part(pair, '+', 2) AS mode, count(*) AS n, 62::BIGINT AS header, true AS same FROM ev JOIN lo ON lo.block_id = ev.block_id GROUP BY ALL")
def marked_payload(spark, sf):
    """Every block's jumps and marks written by its cheapest pair of representation and colour mode, read again and compared."""
    e = A.pp_events(spark, sf)
    pair = costs.best(costs.joint(costs.temporal_costs(), costs.color_costs()))
    choice = block_table(spark, sf).withColumn("pair", F.split(pair["name"], r"\+")).select("block_id", F.col("pair")[0].alias("form"), F.col("pair")[1].alias("mode"), F.lit(0).alias("code"))
    p = codec.marked_payloads(e, choice, A.R, 5)
    back = codec.marked_rows(p).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("i", "t", "mark"))).alias("b"))
    own = e.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "mark"))).alias("o"))
    both = p.join(back, "block_id").join(own, "block_id")
    same = F.transform("b", lambda x: F.struct(x["t"].alias("t"), x["mark"].cast("int").alias("mark"))) == F.transform("o", lambda x: F.struct(x["t"].alias("t"), x["mark"].cast("int").alias("mark")))
    return rounded(both.select("block_id", "form", "mode", F.size("o").cast("long").alias("n"), "header", same.alias("same")))


_LEN = oracles.ORACLE_SQL["block_process_lengths"]


@query(f"SELECT block, gop, process, (CASE process WHEN 'mono' THEN mono WHEN 'pp' THEN pp WHEN 'spatial' THEN spatial ELSE markov END)::BIGINT AS bits, true AS lossless FROM ({_LEN})")
def block_payload(spark, sf):
    """Every block of pixels written by its shortest process and read again: bits as the description lengths say, nothing lost."""
    g = codec.group_of_pictures(A.grid_emb(spark, sf), description.LONGEST)
    lengths = description.block_lengths(description.pixels(A.grid_emb(spark, sf)))
    p = codec.block_payloads(g, lengths)
    from pyspark.sql.window import Window as W

    place = g.select("block", "gop", F.dense_rank().over(W.partitionBy("block", "gop").orderBy("x")).alias("x1"), (F.col("f") % description.LONGEST).alias("k"), F.col("c").alias("own"))
    check = place.withColumn("x", F.col("x1") - 1).join(codec.block_cells(p), ["block", "gop", "x", "k"], "full")
    good = check.groupBy("block", "gop").agg(F.bool_and(F.coalesce(F.col("own") == F.col("c"), F.lit(False))).alias("lossless"))
    return rounded(p.select("block", "gop", "process", "bits").join(good, ["block", "gop"]))


_MODE = _least(["Ba", "Bb", "Bc", "Bd"], "cc", "lb")


@query(f"""WITH {_EV}, sq AS (SELECT block_id, mark, lag(mark) OVER (PARTITION BY block_id ORDER BY t, seq) AS pm FROM ev) SELECT block_id, (count(*) * 3)::BIGINT AS uniform_bits, (count(*) - 1 + 3 * count(*) FILTER (pm IS NULL OR pm <> mark))::BIGINT AS sequential_bits,
 sum(1 + floor(log2(mark + 1)) + 2 * floor(log2(1 + floor(log2(mark + 1)))))::BIGINT AS elias_bits, true AS same FROM sq GROUP BY block_id""")
def color_round_trips(spark, sf):
    """Marks of a block by each of the four colour coders: bits, and whether all give the marks back."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = pdf.sort_values(["t", "seq"])["mark"].astype(int).tolist()
        size, same = {}, True
        for mode in codec.MARKS:
            w = bits.BitWriter()
            codec.write_marks(w, marks, 5, mode)
            size[mode] = w.size
            same &= codec.read_marks(bits.BitReader(w.bytes()), len(marks), 5, mode) == marks
        return pd.DataFrame([(pdf["block_id"].iloc[0], size["Bb"], size["Ba"], size["Bd"], same)], columns=["block_id", "uniform_bits", "sequential_bits", "elias_bits", "same"])

    return A.pp_events(spark, sf).select("block_id", "t", "seq", "mark").groupBy("block_id").applyInPandas(one, "block_id long, uniform_bits long, sequential_bits long, elias_bits long, same boolean")


@query(f"WITH {_EV}, c AS (SELECT block_id, mark, count(*) AS n FROM ev GROUP BY ALL), h AS (SELECT block_id, sum(n) AS n, count(*) AS m, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS H FROM c GROUP BY block_id) SELECT block_id, n::BIGINT AS n, true AS within FROM h")
def huffman_gate(spark, sf):
    """Average bits of a block's Huffman code lie between its entropy and one more bit."""
    from jumpmark.functions import coding
    from jumpmark.operators import features

    c = features.mark_counts(A.pp_events(spark, sf))
    t = coding.huffman_table(c).join(c, ["block_id", "mark"]).groupBy("block_id").agg((F.sum(F.col("n") * F.length("code")) / F.sum("n")).alias("average"))
    e = features.entropy(c)
    within = (F.col("average") >= F.col("H") - 1e-9) & (F.col("average") <= F.greatest(F.col("H") + 1, F.lit(1.0)) + 1e-9)
    return rounded(e.join(t, "block_id").select("block_id", F.col("N").alias("n"), within.alias("within")))


@query(f"SELECT block, gop, indexed AS bits, true AS same FROM ({choices.ORACLE_SQL['index_gain']})")
def indexed_payload(spark, sf):
    """Every block of pixels written by a palette and combinations and read again; bits as index_gain says."""
    return rounded(codec.indexed_blocks(codec.group_of_pictures(A.grid_emb(spark, sf), description.LONGEST)))


@query(None)
def pixel_process(spark, sf):
    """Blocks as independent pixels: bits with colours by a Huffman code where it pays."""
    g = A.grid_emb(spark, sf)
    return rounded(description.pixel_process_bits(description.pixels(g), description.step_colors(g)))
