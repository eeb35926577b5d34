"""Token counts of a unigram tokenizer by a Viterbi search that carries counts only.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position, the longest
first. Dynamic programming keeps per position the best score, the number of tokens on that path
and whether it ends in an unknown character; no lattice, path or token is built.

Tie rules are the tokenizer's: among equal scores the piece that starts first (the longest)
stays; a character that is no piece of its own is an unknown candidate, ``10`` below the
lowest score, and comes last. Unknown characters become their UTF-8 bytes if the vocabulary has
all byte pieces, else a run of them is one token.

If no piece has a blank after another character, all scores are whole numbers (sums are
then exact in any order) and unknown characters become bytes, every path breaks before each run of blanks. Words are then searched
once and remembered; else a text is searched as a whole.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value, inputs

by_value(__name__)

BLANK = "▁"
PENALTY = 10.0
REMEMBERED, LONGEST = 400_000, 64
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class CountOnlyViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        lowest = min((score for _, score in vocabulary), default=0.0)
        names = set()
        for piece, score in vocabulary:
            # As in a lookup table, the last of equal pieces holds.
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
                names.add(piece)
        self.pieces.make_automaton()
        self.unknown = lowest - PENALTY
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        # Runs of unknown characters would go on over a break, but single bytes do not.
        self.by_words = self.bytes and all(score == int(score) for _, score in vocabulary) and not any(
            re.search(f"[^{BLANK}]{BLANK}", piece) for piece in names
        )
        self.known: dict[str, int] = {}

    def search(self, text: str) -> int:
        """Tokens on the best path over a normalised text."""
        n = len(text)
        score, count, broken = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        at, single = 0, False

        def close(end: int) -> None:
            """The unknown candidate for the character that ends here."""
            start = end - 1
            value = score[start] + self.unknown
            if score[end] is None or value > score[end]:
                if self.bytes:
                    more = len(text[start].encode())
                else:
                    more = 0 if broken[start] else 1
                score[end], count[end], broken[end] = value, count[start] + more, True

        for last, (length, worth) in self.pieces.iter(text):
            end = last + 1
            while at < end:
                if at and not single:
                    close(at)
                at, single = at + 1, False
            single |= length == 1
            value = score[end - length] + worth
            if score[end] is None or value > score[end]:
                score[end], count[end], broken[end] = value, count[end - length] + 1, False
        while at <= n:
            if at and not single:
                close(at)
            at, single = at + 1, False
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_words:
            return self.search(BLANK + text.replace(" ", BLANK))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if "  " in text or text[0] == " " or text[-1] == " " or BLANK in text:
            segments = Counter(SEGMENT.findall(BLANK + text.replace(" ", BLANK)))
        else:
            segments = {BLANK + word: n for word, n in Counter(text.split(" ")).items()}
        return sum(n * self.of_segment(segment) for segment, n in segments.items())

    def of_segment(self, segment: str) -> int:
        found = self.known.get(segment)
        if found is None:
            found = self.search(segment)
            if len(segment) <= LONGEST:
                self.known[segment] = found
        return found


def vocabulary_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, control pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [
        (model.id_to_piece(i), float(model.get_score(i))) for i in range(model.vocab_size()) if not model.is_control(i)
    ]


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_bytes, n_tokens) of every row.

    A text gets a blank before it and blanks become ``▁``; nothing else is normalised. A null or
    empty text has no tokens. Rows repeated are counted each; ids may be null; an empty table
    gives no rows. Whole texts are searched, in time linear in their length.
    """
    docs = inputs(docs, "documents", doc_id=doc_id, text=text)

    def run(batches):
        viterbi = None
        for batch in batches:
            viterbi = viterbi or CountOnlyViterbi(vocabulary_of(model_path))
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array((len(t.encode()) for t in texts), pa.int64()),
                    pa.array(map(viterbi.count, texts), pa.int64()),
                ],
                ["doc_id", "n_chars", "n_bytes", "n_tokens"],
            )

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_chars long, n_bytes long, n_tokens long"
    )
