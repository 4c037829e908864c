"""Encoding a corpus with a public byte-level BPE vocabulary, inside Catalyst.

A text is split by the vocabulary's pattern; each word, as the hex string of its bytes, is looked up in a
literal map of ranks kept in buckets by checksum. A word that is no token of its own is folded: a
higher-order fold over its byte pieces merges the adjacent pair of lowest rank, leftmost first, until no
pair has a rank. The distinct words met most often in a bounded sample of documents are folded once
beforehand and join the literal map; that choice affects speed only, every word of every text is encoded.
Decoding looks the pieces up by id and concatenates them.

Defined results: a null or empty text has the empty list of ids; special tokens are never produced and
their strings are ordinary text; repeated rows give repeated rows; an empty table gives an empty result;
columns other than those named are ignored. Texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_sample

#: The vocabulary's splitting pattern, with white space spelled as the Unicode property; fixed value.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
BUCKETS = 1 << 14
#: Documents (about) and distinct words (at most) the beforehand folding looks at.
SAMPLE_DOCUMENTS = 3000
SAMPLE_WORDS = 20_000
_NONE = 1 << 30


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[str, int]:
    """Hex string of a token's bytes to its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token).hex().upper(): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def _literal(entries: dict[str, list[int]]) -> Column:
    """The entries as one literal: an array of buckets, each a map from hex strings to ids."""
    buckets: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    for word, ids in entries.items():
        buckets[zlib.crc32(word.encode()) & (BUCKETS - 1)][word] = ids
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,array<int>>>")


def _look(known: Column, word: Column) -> Column:
    return F.element_at(F.get(known, F.crc32(word).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), word)


def _rank(known: Column, word: Column) -> Column:
    ids = _look(known, word)
    return F.when(F.size(ids) == 1, ids[0])


def _fold(known: Column, word: Column) -> Column:
    """Ids of a word that is not in the map, by ranked merges over its bytes.

    The ranks of adjacent pairs are kept beside the pieces, so a merge looks up only the two pairs it makes.
    """
    count = (F.length(word) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(word, i * 2 + 1, F.lit(2)))
    pair = lambda a, b: F.coalesce(_rank(known, F.concat(a, b)), F.lit(_NONE))
    ranks = F.when(count > 1, F.transform(F.sequence(F.lit(0), count - 2), lambda i: pair(F.substr(word, i * 2 + 1, F.lit(2)), F.substr(word, i * 2 + 3, F.lit(2)))))
    start = F.struct(pieces.alias("pieces"), F.coalesce(ranks, F.array().cast("array<int>")).alias("ranks"))

    def merge(state: Column, _: Column) -> Column:
        best = F.coalesce(F.array_min(state["ranks"]), F.lit(_NONE))

        def joined(at: Column) -> Column:
            pieces, ranks = state["pieces"], state["ranks"]
            new = F.concat(F.get(pieces, at), F.get(pieces, at + 1))
            before = F.when(at > 0, F.concat(F.slice(ranks, F.lit(1), at - 1), F.array(pair(F.get(pieces, at - 1), new)))).otherwise(F.array().cast("array<int>"))
            after = F.when(at + 2 < F.size(pieces), F.concat(F.array(pair(new, F.get(pieces, at + 2))), F.slice(ranks, at + 3, F.size(ranks))))
            return F.struct(
                F.concat(F.slice(pieces, F.lit(1), at), F.array(new), F.slice(pieces, at + 3, F.size(pieces))).alias("pieces"),
                F.concat(before, F.coalesce(after, F.array().cast("array<int>"))).alias("ranks"),
            )

        at = (F.array_position(state["ranks"], best) - 1).cast("int")
        return F.when(best == _NONE, state).otherwise(F.transform(F.array(at), joined)[0])

    return F.aggregate(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), start, merge, lambda s: F.transform(s["pieces"], lambda p: _rank(known, p)))


def words_of(text: Column) -> Column:
    """Hex strings of the words the pattern splits a text into."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0)), lambda w: F.hex(w))


def encoded(text: Column, entries: dict[str, list[int]]) -> Column:
    """Ids of a text as a column, given the literal map's entries; the map is bound once."""
    words = words_of(text)
    each = F.transform(F.array(_literal(entries)), lambda known: F.transform(words, lambda w: F.coalesce(_look(known, w), _fold(known, w))))
    return F.flatten(each[0])


def map_entries(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> dict[str, list[int]]:
    """Entries of the literal map: every token, and the distinct words of a bounded sample that are folded beforehand."""
    tokens = {word: [rank] for word, rank in read_ranks(path or default_ranks()).items()}
    sample = (
        hash_sample(df, id_col, SAMPLE_DOCUMENTS)
        .select(F.explode(words_of(F.col(text_col).cast("string"))).alias("word"))
        .where(F.length("word") <= 128)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    odd = sample.orderBy(F.desc("n"), "word").limit(4 * SAMPLE_WORDS)
    known = F.array(_literal(tokens))
    folded = odd.select("word", F.transform(known, lambda k: F.when(_look(k, F.col("word")).isNull(), _fold(k, F.col("word"))))[0].alias("ids"))
    return tokens | {r["word"]: r["ids"] for r in folded.where("ids is not null").limit(SAMPLE_WORDS).collect()}


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens."""
    entries = map_entries(df, id_col, text_col, path)
    return df.select(id_col, encoded(F.col(text_col).cast("string"), entries).alias("ids"))


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the texts of lists of ids, by concatenating the tokens' bytes."""
    by_rank = sorted((rank, word) for word, rank in read_ranks(path or default_ranks()).items())
    pieces = F.split(F.lit(",".join(word for _, word in by_rank)), ",")
    joined = F.transform(F.array(pieces), lambda p: F.array_join(F.transform(F.col(ids_col), lambda i: F.get(p, i)), ""))[0]
    return df.select(id_col, F.decode(F.unhex(joined), "UTF-8").alias("text"))
