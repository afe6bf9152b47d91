"""Model inputs from token arrays, and model outputs back to tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.unicode import basic_tokens
from ..options import DEFAULTS
from . import tokens as tok

# Fixed value: what separates the two texts of a pair.
PAIR_PATTERN = r"^(.*) \|\|\| (.*)$"


def split_pairs(df: DataFrame, text: str = "sentence") -> DataFrame:
    """Split ``a ||| b`` at the last separator; ``text_b`` is null otherwise."""
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    is_pair = F.rlike(trimmed, F.lit(PAIR_PATTERN))
    a = F.when(is_pair, F.regexp_extract(trimmed, PAIR_PATTERN, 1)).otherwise(trimmed)
    b = F.when(is_pair, F.regexp_extract(trimmed, PAIR_PATTERN, 2))
    return df.withColumns({"text_a": a, "text_b": b})


def kept_lengths(size_a: Column, size_b: Column, total: int) -> tuple[Column, Column]:
    """Lengths after always dropping from the longer side (a tie drops from b)."""
    fits = size_a + size_b <= total
    half = F.ceil(F.lit(total) / 2).cast("int")
    a = F.least(size_a, F.greatest(half, F.lit(total) - size_b))
    b = F.least(size_b, F.lit(total) - a)
    return F.when(fits, size_a).otherwise(a), F.when(fits, size_b).otherwise(b)


def framed(a: Column, b: Column, cls: Column, sep: Column) -> Column:
    """``[CLS] a [SEP] b [SEP]``, for tokens or for ids; without b when that is empty."""
    second = F.when(F.size(b) > 0, F.concat(b, F.array(sep))).otherwise(b)
    return F.concat(F.array(cls), a, F.array(sep), second)


def type_ids(size_a: Column, size_b: Column) -> Column:
    """0 for ``[CLS] a [SEP]``, 1 for ``b [SEP]``."""
    second = F.when(size_b > 0, size_b + 1).otherwise(0)
    return F.concat(F.array_repeat(F.lit(0), size_a + 2), F.array_repeat(F.lit(1), second))


def _padded(ints: Column, length: int) -> Column:
    filled = F.concat(ints, F.array_repeat(F.lit(0), F.lit(length) - F.size(ints)))
    too_long = F.raise_error(F.lit(f"input is longer than {length}"))
    return F.when(F.size(filled) == length, filled).otherwise(too_long)


def special_id(vocab: DataFrame, token: str) -> Column:
    """Id of a special token as a scalar subquery."""
    return vocab.filter(F.col("token") == token).select("id").scalar()


def model_inputs(
    df: DataFrame, vocab: DataFrame, keys: Sequence[str], length: int = DEFAULTS.max_seq_length
) -> DataFrame:
    """Fixed-length ids, mask and type ids next to the unpadded tokens; no shuffle.

    ``df`` has ``tokens_a``/``ids_a`` and ``tokens_b``/``ids_b`` (empty when there is no b).
    """
    size_a, size_b = F.size("tokens_a"), F.size("tokens_b")
    pair_a, pair_b = kept_lengths(size_a, size_b, length - 3)
    lengths = df.withColumns(
        {
            "_a": F.when(size_b > 0, pair_a).otherwise(F.least(size_a, F.lit(length - 2))),
            "_b": F.when(size_b > 0, pair_b).otherwise(0),
            "_cls": special_id(vocab, "[CLS]"),
            "_sep": special_id(vocab, "[SEP]"),
        }
    )

    def part(name: str) -> tuple[Column, Column]:
        return F.slice(f"{name}_a", 1, F.col("_a")), F.slice(f"{name}_b", 1, F.col("_b"))

    rows = lengths.select(
        *keys,
        framed(*part("tokens"), F.lit("[CLS]"), F.lit("[SEP]")).alias("tokens"),
        framed(*part("ids"), F.col("_cls"), F.col("_sep")).alias("_ids"),
        type_ids(F.col("_a"), F.col("_b")).alias("_types"),
    )
    return rows.select(
        *keys,
        "tokens",
        _padded(F.col("_ids"), length).alias("input_ids"),
        _padded(F.array_repeat(F.lit(1), F.size("_ids")), length).alias("input_mask"),
        _padded(F.col("_types"), length).alias("input_type_ids"),
    )


def encode_texts(
    texts: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str] = ("doc_id", "pos"),
    text: str = "sentence",
    length: int = DEFAULTS.max_seq_length,
) -> DataFrame:
    """Texts or ``a ||| b`` pairs to model inputs; no row is moved while the vocabulary fits."""
    keys = list(keys)
    pairs = split_pairs(texts, text)
    if tok.fits(vocab):
        both = pairs.select(*keys, *[
            tok.pieces_of(basic_tokens(F.col(f"text_{side}")), vocab).alias(f"_{side}") for side in "ab"
        ])
        columns = [F.col(f"_{side}.{field}").alias(f"{name}_{side}") for side in "ab" for field, name in (("tokens", "tokens"), ("ids", "ids"))]
        return model_inputs(both.select(*keys, *columns), vocab, keys, length)
    sides = pairs.select(
        *keys, F.posexplode(F.array("text_a", "text_b")).alias("side", "piece")
    ).filter((F.col("side") == 0) | F.col("piece").isNotNull())
    words = tok.words_of(sides, [*keys, "side"], "piece")
    joined = tok.attach_pieces(words, vocab, F.struct(*keys, "side", "tok"))
    grouped = joined.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("side", "tok", "pieces", "ids"))).alias("_w")
    )

    def of(side: int, field: str) -> Column:
        mine = F.filter("_w", lambda w: (w["side"] == side) & w["tok"].isNotNull())
        return F.flatten(F.transform(mine, lambda w: w[field]))

    both = grouped.select(
        *keys,
        of(0, "pieces").alias("tokens_a"),
        of(0, "ids").alias("ids_a"),
        of(1, "pieces").alias("tokens_b"),
        of(1, "ids").alias("ids_b"),
    )
    return model_inputs(both, vocab, keys, length)


Model = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def embed(
    inputs: DataFrame,
    make_model: Callable[[], Model],
    layers: Sequence[int] = DEFAULTS.layers,
    batch_size: int = DEFAULTS.batch_size,
    length: int = DEFAULTS.max_seq_length,
) -> DataFrame:
    """Run the user's model in batches and attach its vectors to the tokens.

    ``make_model`` is called once per task and returns a function from ids, mask and
    type ids (batch x length) to vectors (batch x layers x length x dim). The result has
    one record per input: ``features`` with a token and its layers, padding left out.
    """
    wanted = list(layers)

    def make_predict() -> Model:
        model = make_model()

        def predict(input_ids: np.ndarray, input_mask: np.ndarray, input_type_ids: np.ndarray) -> np.ndarray:
            out = model(input_ids, input_mask, input_type_ids)
            return out[:, wanted].reshape(len(out), -1).astype(np.float32)

        return predict

    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[[length]] * 3,
    ).asNondeterministic()  # no filter is pushed below the model, which would run it twice
    flat = inputs.withColumn("_flat", predict("input_ids", "input_mask", "input_type_ids"))
    n = len(wanted)
    dim = (F.size("_flat") / (n * length)).cast("int")

    def vector(layer: int, token: Column) -> Column:
        return F.slice("_flat", (F.lit(layer * length) + token) * F.col("_dim") + 1, F.col("_dim"))

    features = F.transform(
        "tokens",
        lambda t, i: F.struct(
            t.alias("token"),
            F.array(
                *[
                    F.struct(
                        F.lit(layer).cast("bigint").alias("index"),
                        vector(k, i).cast("array<double>").alias("values"),
                    )
                    for k, layer in enumerate(wanted)
                ]
            ).alias("layers"),
        ),
    )
    return flat.withColumn("_dim", dim).withColumn("features", features).drop(
        "_flat", "_dim", "tokens", "input_ids", "input_mask", "input_type_ids"
    )


def attach_outputs(features: DataFrame, outputs: DataFrame, keys: Sequence[str], vectors: str = "vectors") -> DataFrame:
    """Join a table of model outputs to its tokens; vectors of padding are cut off."""
    kept = F.slice(vectors, 1, F.size("tokens"))
    zipped = F.arrays_zip(F.col("tokens").alias("token"), kept.alias("values"))
    joined = features.select(*keys, "tokens").join(outputs, list(keys))
    return joined.select(*keys, F.inline(F.transform(zipped, lambda z: F.struct(
        z["token"].alias("token"), z["values"].alias("values")
    ))))
