"""Reading level of documents: a familiar-word formula over their English prose.

Two numbers make the score, and nothing else: the share of words outside a list of familiar words, and the logarithm of
the mean sentence length. The list holds the words that stand in at least a given share of the corpus's own documents of
English prose. A sentence is measured by its main clauses: where a coordinator opens a new main clause, a new sentence
begins (the minimal terminable unit of readability research), so that a chain of plain clauses is not long, while
subordinate clauses stay in the sentence they are nested in. Human levels of a bounded sample only set the two weights,
the cut-off, and the share from which a word is familiar.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shared import Scratch, row_count

#: shares of documents from which a word may be called familiar; the labels decide between them
FAMILIAR_SHARES = tuple(k / 100 for k in range(5, 21))
FAMILIAR_SHARE = 0.12
LEAST_ENGLISH = 0.12
MIN_WORDS = 20
MAX_LABELS = 5_000

FENCE = re.compile(r"^\s*(?:```|~~~)")
INLINE = re.compile(r"`[^`\n]*`|<[^<>\n]{1,200}>|https?://\S+|\b\S+@\S+\.\w+|\bv?\d+(?:\.\d+)+\b|!?\[[^\]\n]*\]\([^)\n]*\)")
BULLET = re.compile(r"^\s*(?:[-*+•>]+|\d+[.)]|[#=]+)\s+")
HEADING = re.compile(r"^\s*(?:#{1,6}|={1,6})\s")
CODE_LINE = re.compile(
    r"[{};]\s*$|^\s*(?:func|package|import|return|type|var|const|def|class|if|for|switch|case|go|defer|SELECT|MATCH|WHERE|RETURN|WITH|CREATE|MERGE|ORDER|LIMIT|FROM)\b(?=.*[(){}\[\]=:*]|\s+[\"(])|:=|^\s*//|^\s*[\w.]+\(.*\)\s*$|^\s*[\]})]|^\s*[\"'{\[]"
)
STAMP = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
LOG_LINE = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d|\b(?:INFO|WARN|DEBUG|ERROR|TRACE|FATAL)\b.*=|(?:\w+=\S+\s*){2,}")
TABLE_LINE = re.compile(r"^\s*\||\|\s*$|\t\S+\t|^(?:[^,;\n]{0,40}[,;]){4,}[^,;\n.]*$|^[-+=|:\s]+$")
#: a line of words alone: none of the other patterns can tell more of it
WORDS_ONLY = re.compile(r"[A-Za-z][A-Za-z ,.;:'’?!-]*\Z")
ABBREVIATIONS = frozenset("e.g i.e cf etc vs no fig al resp approx dr mr mrs st prof".split())
PLAIN = re.compile(r"^[A-Za-z]+(?:[-'’][A-Za-z]+)*$")
INNER_CAPITAL = re.compile(r"[a-z][A-Z]|[A-Z]{2,}[a-z]")
#: frequent English words that carry no topic, and frequent words of other languages that are no English words
ENGLISH = frozenset(
    """the of and to in is are was were be been it that this these those which who whose with for as by on at from or not but if when while than then each every its their
    his her our your my we you they he she there here has have had do does did can could will would should may might must no nor so such how what why where all any some most more
    only into out over under between before after because since until unless although though albeit however whereas a an i me us them one two""".split()
)
OTHER = frozenset(
    """der die das und ist nicht ein eine einen wird werden mit von zu den dem des auf für im sich auch nach bei aus wenn oder noch ob jede jeden jedes el la los las un una que se es en del por
    con para como más pero le les et est une des dans pour sur pas qui ne du au ce cette chaque aux ou o os as um uma não em no na dos das da do ao são foi cada antes después il lo gli che non per""".split()
)
#: coordinators, and words that begin the subject of a main clause after one
JOINS = frozenset("and but so or then".split())
SUBJECTS = frozenset("the a an it we you they he she i this these those there each every no our your their its his her my all some one".split())


ENDS, OURS, THEIRS = 1, 2, 4
WORD_MARKS = OURS | THEIRS
MEMO_TOKENS = 200_000


class _Tokens(dict):
    """What a token between blanks is: its word ("" if it is none) and its marks. Forgets all when it grows too large."""

    def __missing__(self, raw: str) -> tuple[str, int]:
        bare = raw.strip(".,;:!?()[]\"'“”‘’*_…«»")
        mark = ENDS if raw.rstrip(")]\"'”’»*_")[-1:] in (".", "!", "?", "…") and bare.lower() not in ABBREVIATIONS else 0
        word = ""
        if PLAIN.match(bare) and not INNER_CAPITAL.search(bare):
            word = bare.lower().replace("’", "'")
        elif not bare.isascii() and bare.isalpha():  # letters of other scripts stay, to tell the language
            word = bare.lower()
        if word in ENGLISH:
            mark |= OURS
        if word in OTHER or not word.isascii():
            mark |= THEIRS
        if len(self) > MEMO_TOKENS:
            self.clear()
        self[raw] = got = (word, mark)
        return got


_tokens = _Tokens()


def main_clauses(words: list[str]) -> int:
    """How many main clauses a sentence coordinates: one more than coordinators (or runs of them) that a subject follows
    and that have more than two words before them in their clause."""
    joins = [i for i, w in enumerate(words) if w in JOINS]
    count, begun, k = 1, 0, 0
    while k < len(joins):
        after = joins[k] + 1
        k += 1
        if after - begun > 3:
            while k < len(joins) and joins[k] == after:
                after, k = after + 1, k + 1
            if after < len(words) and words[after] in SUBJECTS:
                count, begun = count + 1, after
    return count


def prose_sentences(text: str) -> list[tuple[list[str], int]]:
    """Words of each English sentence and how many main clauses it has. Code, tables, logs, headings, markup, paths
    and identifiers are left out; lines are joined to paragraphs first."""
    sentences: list[tuple[list[str], int]] = []
    held: list[str] = []
    fenced = False

    def keep(words: list[str], ours: int, theirs: int) -> None:
        if len(words) > 1 and ours // OURS > theirs // THEIRS and ours // OURS >= LEAST_ENGLISH * len(words):
            sentences.append((words, main_clauses(words)))

    def close() -> None:
        words, ours, theirs = [], 0, 0
        for word, mark in map(_tokens.__getitem__, held):
            if word:
                words.append(word)
                if mark & WORD_MARKS:
                    ours += mark & OURS
                    theirs += mark & THEIRS
            if mark & ENDS:
                keep(words, ours, theirs)
                words, ours, theirs = [], 0, 0
        keep(words, ours, theirs)
        held.clear()

    for line in text.splitlines():
        if not fenced and WORDS_ONLY.match(line):
            held.extend(line.split())
            continue
        if FENCE.match(line):
            fenced = not fenced
            close()
            continue
        if fenced or not line.strip():
            close()
            continue
        if HEADING.match(line) or STAMP.match(line) or ((TABLE_LINE.search(line) or LOG_LINE.search(line) or CODE_LINE.search(line)) and not _reads(line)):
            close()
            continue
        if bullet := BULLET.match(line):
            close()
            line = line[bullet.end() :]
        held.extend(INLINE.sub(" ", line).split())
    close()
    return sentences


def _reads(line: str) -> bool:
    words = [_tokens[w][1] for w in line.split()]
    return len(words) >= 5 and sum(w & OURS for w in words) >= 0.25 * OURS * len(words)


PROFILE = "doc_id long, words int, sentences int, terms array<string>, counts array<int>"


def _profile(doc_id: int, text: str | None) -> tuple:
    sentences = prose_sentences(text) if text else []
    terms: Counter = Counter()
    for words, _ in sentences:
        terms.update(words)
    return doc_id, sum(terms.values()), sum(n for _, n in sentences), list(terms), list(terms.values())


def prose_profiles(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its prose counts (words; sentences by main clauses) and its words; documents without
    prose have zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "words", "sentences", "terms", "counts"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_profile(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=names)

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PROFILE)


# ---- fitting and scoring

#: weights of (1, unfamiliar share, log of the words a sentence) where there are no labels: for the cut-off and the level
UNFITTED = np.array([-14.0, 11.0, 3.4])
LEVELS_UNFITTED = np.array([-1.5, 4.0, 1.4])
RIDGE = 1.0


def _bounded(labels: DataFrame, doc_id: str, level: str, rater: str) -> DataFrame:
    """doc_id, level: the median of the raters' possible levels, for at most MAX_LABELS documents by hash."""
    valid = labels.where(F.col(level).between(1, 5) & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(rater).alias("rater"), F.col(level).alias("level")).distinct()
    middle = valid.groupBy("doc_id").agg(F.expr("percentile(level, 0.5)").alias("level"))
    return middle.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[offsets])


def formula_terms(table: pa.Table | pa.RecordBatch, familiar: frozenset[str]) -> np.ndarray:
    """Rows (1, unfamiliar share, log of the words a sentence) of prose profiles."""
    terms, counts = table.column("terms"), table.column("counts")
    if isinstance(terms, pa.ChunkedArray):
        terms, counts = terms.combine_chunks(), counts.combine_chunks()
    offsets = terms.offsets.to_numpy() - terms.offsets[0].as_py()
    coded = terms.flatten().dictionary_encode()
    strange = np.array([w not in familiar for w in coded.dictionary.to_pylist()] or [False], dtype=np.float64)
    n = counts.flatten().to_numpy().astype(np.float64)
    words = np.maximum(1, table.column("words").to_numpy())
    sentences = np.maximum(1, table.column("sentences").to_numpy())
    return np.stack([np.ones(len(words)), _sums(strange[coded.indices.to_numpy()] * n, offsets) / words, np.log(words / sentences)], axis=1)


@dataclass(frozen=True)
class ReadingModel:
    """The familiar words and the weights of the formula's terms; of bounded size."""

    familiar: frozenset[str]
    share: float
    weights: np.ndarray
    level_weights: np.ndarray


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    mean, spread = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
    z = np.concatenate([x[:, :1], (x[:, 1:] - mean) / spread], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    return np.concatenate([[w[0] - (w[1:] * mean / spread).sum()], w[1:] / spread])


def _linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    spread = np.concatenate([[1.0], x[:, 1:].std(axis=0) + 1e-9])
    z = x / spread
    return np.linalg.solve(z.T @ z + 1e-3 * np.eye(z.shape[1]), z.T @ y) / spread


def fit(profiles: DataFrame, labels: DataFrame, *, shares: tuple[float, ...] = FAMILIAR_SHARES, doc_id: str = "doc_id", level: str = "level_no", rater: str = "rater") -> ReadingModel:
    """Familiar words from the document frequencies of all profiles; weights from at most MAX_LABELS labelled documents.

    Frequencies count documents of at least MIN_WORDS words. No more than (mean number of different words of a document)
    / (least share) words can reach the least share, which bounds the list. Of ``shares`` the one with the greatest
    likelihood of the labels holds, the smallest of equals. Impossible and null levels, unknown documents and repeated
    labels are ignored; of several raters the median holds. With fewer than 30 labelled documents, or only one side of
    the scale, the unfitted formula and the share nearest to FAMILIAR_SHARE are used.
    """
    prose = profiles.where(F.col("words") >= MIN_WORDS)
    total = row_count(prose)
    frequency = prose.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = frequency.where(F.col("df") >= min(shares) * max(1, total)).collect()
    familiar = lambda share: frozenset(r["term"] for r in known if r["df"] >= share * total)
    graded = prose.join(_bounded(labels, doc_id, level, rater), "doc_id").toArrow()
    y = graded.column("level").to_numpy()
    hard = (y >= 3.5).astype(np.float64)
    if len(y) < 30 or hard.all() or not hard.any():
        share = min(shares, key=lambda s: abs(s - FAMILIAR_SHARE))
        return ReadingModel(familiar(share), share, UNFITTED, LEVELS_UNFITTED)
    best = None
    for share in sorted(shares):
        x = formula_terms(graded, familiar(share))
        weights = _logistic(x, hard)
        likelihood = -np.logaddexp(0, -np.where(hard > 0, 1, -1) * (x @ weights)).mean()
        if best is None or likelihood > best[0] + 1e-12:
            best = likelihood, ReadingModel(familiar(share), share, weights, _linear(x, y))
    return best[1]


def score(profiles: DataFrame, model: ReadingModel) -> DataFrame:
    """doc_id, words, unfamiliar, sentence_words, level (1 .. 5), demanding of every document.

    Documents with fewer than MIN_WORDS words of English prose have a null level and are not demanding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = formula_terms(batch, model.familiar)
            few = batch.column("words").to_numpy() < MIN_WORDS
            values = [x[:, 1], np.exp(x[:, 2]), np.clip(x @ model.level_weights, 1.0, 5.0)]
            arrays = [batch.column("doc_id"), batch.column("words"), *[pa.array(v, mask=few) for v in values], pa.array(~few & (x @ model.weights > 0))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "words", "unfamiliar", "sentence_words", "level", "demanding"])

    return profiles.mapInArrow(run, "doc_id long, words int, unfamiliar double, sentence_words double, level double, demanding boolean")


def reading_levels(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shares: tuple[float, ...] = FAMILIAR_SHARES) -> DataFrame:
    """``score`` of a whole corpus under a model fitted to it.

    * Null, empty and blank texts, texts in other languages and without prose have 0 words. Whole texts are read.
    * Repeated documents are scored each and count each for the document frequencies; a word is familiar by its share
      alone, so there are no ties to break.
    * No documents, no rows; other columns are not read.
    """
    profiles, _, _ = Scratch(documents.sparkSession, "reading").cut(prose_profiles(documents, doc_id, text))
    return score(profiles, fit(profiles, labels, shares=shares))
