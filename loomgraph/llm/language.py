"""Language of documents and of their single-language stretches, by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary; the probability of a word is the
sum over all its segmentations into pieces, computed by a forward pass. The piece probabilities are fitted by
expectation maximisation (forward-backward over the same segmentations) to the word counts of a sample of
labelled documents, at most SAMPLE_DOCS a language under the SAMPLE_LABELS most frequent labels and SAMPLE_WORDS words
of at most SAMPLE_LETTERS letters in all; frequent function words are
added as pseudo counts, so a language that is rare in the sample is still known. Scoring covers every line of
every document in a ``mapInArrow`` stage that keeps the scores of words already seen.

Lines are the unit: fenced and code-like lines, paths and blank lines hold no prose and are passed over; inline
code, paths, identifiers and numbers are left out of the rest. A stretch is a longest run of prose lines in one
language. Lines too short to decide on their own take the language of the line before (or else after) them when
that is possible at all.

Defined results
 * A label is read in any notation (code, region, name); null, blank or unreadable labels are missing. A label of
   a language that isn't among LANGUAGES is wrong for any text.
 * Null, empty and code-only texts have no stretches. Mis-decoded accents are repaired and accents folded before
   scoring. Rows repeat freely and are scored one by one; texts and words are scored whole, whatever their length.
 * Ties between languages go to the one first in LANGUAGES.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_scan
from .names import fold

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl")
#: Where the public vocabulary lies.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_LETTERS, SAMPLE_LABELS, ROUNDS, PSEUDO = 600, 40_000, 64, 1000, 4, 3.0
#: Posterior below which a line takes its neighbour's language.
UNSURE = 0.95
#: Names of languages in labels, folded.
LABELS = {
    "en": "en eng english englisch anglais ingles inglese engels", "de": "de deu ger german deutsch allemand aleman tedesco alemao duits", "fr": "fr fra fre french franzosisch francais frances francese frans",
    "es": "es spa spanish spanisch espagnol espanol castellano castilian spagnolo espanhol spaans", "it": "it ita italian italienisch italien italiano italiaans", "pt": "pt por portuguese portugiesisch portugais portugues portoghese portugees",
    "nl": "nl nld dut dutch niederlandisch neerlandais neerlandes holandes olandese nederlands flemish vlaams",
}
#: Labels that name no language.
NO_LABELS = "und unknown n/a na none null mul mis zxx xx ? - other undefined multiple mixed unk"
#: Frequent function words, folded.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as his they be at one have this from or had by but not what all were when we there can an your which their if do will each how up out them then she many some so these would other into has more two him see could no than been its who now my made over did down only way find use may after before because",
    "de": "der die und in den von zu das mit sich des auf fur ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem uber einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn wir keinen kein ob nie alle ich ihr unter diese dieser wahrend ohne weil",
    "fr": "le la les de des du et un une en est que dans qui pour pas sur plus par avec ce il elle ne se sont au aux mais ou comme tout nous vous leur sa son ses cette ces fait etre avoir ont apres avant sans sous encore meme bien aussi peut si quand chaque parce que pourquoi ni aucune aucun il y a lorsque des que",
    "es": "el la los las de del y un una en es que por con para no se su al lo como mas pero sus le ya o este si porque esta entre cuando muy sin sobre tambien me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos despues cada solo antes ninguna ningun todavia nunca",
    "it": "il lo la i gli le di del della dei delle e un una in che per con non si da al alla come piu ma anche sono nel nella su dal dalla ha o se dopo prima senza ogni quando perche questo questa solo ancora tutti tutte essere stato suo sua loro due cosi ci gia mai nessun nessuna quello c'e",
    "pt": "o a os as de do da dos das e um uma em no na nos nas que por com para nao se seu sua ao como mais mas foi ele ou ser quando muito ha ja esta eu tambem so pelo pela ate isso ela entre depois sem mesmo aos ter seus quem nem suas meu minha cada antes todos todas nenhuma nenhum ainda nunca apenas assim",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar worden door wordt heeft over hij ze wij we je dit die deze na al wat hun meer geen kan zal tot waar toen elke alle zonder omdat nooit alleen steeds meteen wanneer onder tegen zo worden onze",
}

_FENCE = re.compile(r"^\s*(?:>\s*)*(?:```|~~~)")
_CODE_START = re.compile(r"\s*(?://|/\*|\*/|#!|#include|@\w+\()|\s*(?:const|let|var|return|import|export|function|def|class|func|public|private|if|for|while|await|throw|package|use)\b.*[(){};=]|\s*[\w.]+\s*(?::?=|\+=|=>)\s*\S|\s*[\w.]+\([^)]*\)\s*$|\s*\$ ")
_TICKS = re.compile(r"`[^`]*`")
_LINK = re.compile(r"\[[^\]]*\]\([^)]*\)")
_ARROW = re.compile(r"->\s*\S+")
_TAIL = re.compile(r":\s*\w+-[\w-]+(?=\.?\s*$)")
_ODD = re.compile(r"[/\\_@\d]")
_DOTTED = re.compile(r"\b\w++\.\w+\b(?!\.$)")
_CAMEL = re.compile(r"\b[a-z]++[A-Z]\w*\b")
_MARK = re.compile(r"\(#\d+\)|\[v[\d.]+\]|`[^`]*`")
_LEAD = re.compile(r"\s*(?:>\s*|#+\s+|[-*+]\s+|\d+[.)]\s+)*")
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"[a-z]+")  # of folded plain text
_BROKEN = re.compile("[ÃÂ][\u0080-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ ]")
#: Sums over longer words are kept as logarithms, so that nothing underflows.
_CLOSE, _FLOOR = 24, 1e-9


def label_notation(label: str | None) -> str | None:
    """The language a label names: one of LANGUAGES, 'other', or None when it names none."""
    if label is None:
        return None
    text = fold(label).strip()
    if not text or text in NO_LABELS.split():
        return None
    head = re.split(r"[-_ ,;(/]", text)[0]
    for lang, names in LABELS.items():
        if text in names.split() or head in names.split():
            return lang
    return "other" if re.fullmatch(r"[a-z]{2,3}|[a-z]{4,}", head) and head not in NO_LABELS.split() else None


def repaired(text: str) -> str:
    """Text whose accents were decoded with the wrong table, put right where that is possible."""
    if not _BROKEN.search(text):
        return text
    for table in ("cp1252", "latin-1"):
        try:
            return text.encode(table).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return _BROKEN.sub(lambda m: _pair(m.group()), text)


def _pair(two: str) -> str:
    for table in ("cp1252", "latin-1"):
        try:
            return two.encode(table).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return two


def _prose(line: str) -> str:
    """The line without inline code, links, what arrows point to, paths, numbers and identifiers."""
    if "`" in line:
        line = _TICKS.sub(" ", line)
    if "](" in line:
        line = _LINK.sub(" ", line)
    if "->" in line:
        line = _ARROW.sub(" ", line)
    if ":" in line:
        line = _TAIL.sub(" ", line)
    out = []
    for t in line.split():
        if not (t.isalpha() and t[1:].islower()):
            if _ODD.search(t):
                t = " "
            else:
                if "." in t[1:-1]:
                    t = _DOTTED.sub(" ", t)
                if not t.islower():
                    t = _CAMEL.sub(" ", t)
        out.append(t)
    return " ".join(out)


def prose_lines(text: str | None) -> list[tuple[int, list[str], int]]:
    """(line number from 0, folded words of prose, characters of prose) of each line with prose."""
    out, fenced = [], False
    for n, line in enumerate((text or "").split("\n")):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not line.strip():
            continue
        kept = (_MARK.sub("", line) if "`" in line or "(#" in line or "[v" in line else line).rstrip()
        if kept.endswith((";", "{", "}")) or _CODE_START.match(kept):
            continue
        bare = _prose(line[_LEAD.match(line).end() :])
        plain = fold(repaired(bare))
        words = (_LETTERS if plain.isascii() else _WORD).findall(plain)
        if sum(len(w) > 1 for w in words) >= 2:
            out.append((n, words, len(bare.strip())))
    return out


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The folded letter pieces of the vocabulary; a piece that begins a word begins with a space."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {fold(read.id_to_piece(i).replace("▁", " ")) for i in range(read.get_piece_size()) if not (read.is_control(i) or read.is_byte(i) or read.is_unknown(i))}
    return sorted(p for p in pieces if re.fullmatch(r" ?[^\W\d_]*", p) and p)


class Unigrams:
    """Piece probabilities of each language; score() sums over all segmentations of a word."""

    def __init__(self, pieces: dict[str, np.ndarray]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.logs: dict[str, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.known = np.empty((1024, len(LANGUAGES)))

    def spans(self, word: str) -> list[tuple[int, int, str]]:
        """(start, end, piece) of the pieces in a word, by end."""
        text = " " + word
        return [(i, j, text[i:j]) for j in range(1, len(text) + 1) for i in range(max(0, j - self.longest), j) if text[i:j] in self.pieces]

    def forward(self, word: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
        """Sums over the segmentations of the letters before each position; logarithms for long words."""
        if len(word) <= _CLOSE:
            alpha = np.zeros((len(word) + 2, len(LANGUAGES)))
            alpha[0] = 1.0
            for i, j, piece in spans:
                alpha[j] += alpha[i] * self.pieces[piece]
            return alpha
        alpha = np.full((len(word) + 2, len(LANGUAGES)), -np.inf)
        alpha[0] = 0.0
        for i, j, piece in spans:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.log(piece))
        return alpha

    def log(self, piece: str) -> np.ndarray:
        if (got := self.logs.get(piece)) is None:
            got = self.logs[piece] = np.log(self.pieces[piece])
        return got

    def expected(self, word: str) -> list[tuple[str, np.ndarray]]:
        """(piece, how often it is expected in a segmentation of the word) for each place it has."""
        spans = self.spans(word)
        alpha = self.forward(word, spans)
        if len(word) <= _CLOSE:
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            for i, j, piece in reversed(spans):
                beta[i] += beta[j] * self.pieces[piece]
            whole = np.maximum(alpha[-1], 1e-200)
            return [(piece, alpha[i] * self.pieces[piece] * beta[j] / whole) for i, j, piece in spans]
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0.0
        for i, j, piece in reversed(spans):
            beta[i] = np.logaddexp(beta[i], beta[j] + self.log(piece))
        whole = np.where(np.isfinite(alpha[-1]), alpha[-1], 0.0)
        return [(piece, np.exp(alpha[i] + self.log(piece) + beta[j] - whole)) for i, j, piece in spans]

    def row(self, word: str) -> int:
        """Where the scores of the word lie in ``known``."""
        got = self.at.get(word)
        if got is None:
            got = self.at[word] = len(self.at)
            if got == len(self.known):
                self.known = np.concatenate([self.known, np.empty_like(self.known)])
            last = self.forward(word, self.spans(word))[-1]
            self.known[got] = np.log(np.maximum(last, 1e-200)) if len(word) <= _CLOSE else np.where(np.isfinite(last), last, len(word) * math.log(_FLOOR))
        return got

    def score(self, word: str) -> np.ndarray:
        return self.known[self.row(word)]

    def scores(self, lines: list[list[str]]) -> np.ndarray:
        """The summed scores of the words of each line; no line is empty."""
        if len(self.at) > 300_000:
            self.forget()
        at, row = self.at, self.row
        rows = [got if (got := at.get(w)) is not None else row(w) for words in lines for w in words]
        starts = np.cumsum([0] + [len(words) for words in lines[:-1]])
        return np.add.reduceat(self.known[rows], starts, axis=0)


def fit(counts: dict[str, dict[str, float]], pieces: list[str], rounds: int = ROUNDS) -> Unigrams:
    """Piece probabilities by expectation maximisation on (language -> word -> count)."""
    start = np.array([1.0 / (1 + 4.0 ** (1 - min(len(p.strip()), 6))) for p in pieces])
    table = {p: np.full(len(LANGUAGES), v) for p, v in zip(pieces, start / start.sum())}
    for lang in LANGUAGES:
        counts.setdefault(lang, {})
        for w in re.findall(r"[^\W\d_]+", FUNCTION_WORDS[lang]):
            counts[lang][w] = counts[lang].get(w, 0) + PSEUDO
    alphabet = {c for words in counts.values() for w in words for c in w} | set(" abcdefghijklmnopqrstuvwxyz")
    for c in alphabet:
        for p in (c, " " + c) if c != " " else (" ",):
            table.setdefault(p, np.full(len(LANGUAGES), _FLOOR))
    by_word: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
    for i, lang in enumerate(LANGUAGES):
        total = sum(counts[lang].values())
        for w, n in counts[lang].items():
            by_word[w][i] += n / total * 1e5
    model = Unigrams(table)
    for _ in range(rounds):
        expected: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for word, n in by_word.items():
            for piece, times in model.expected(word):
                expected[piece] += n * times
        total = sum(expected.values()) + 0.0
        model = Unigrams({p: np.maximum(expected[p] / total if p in expected else 0.0, _FLOOR) * np.ones(len(LANGUAGES)) for p in model.pieces})
    return model


def sample_counts(documents: DataFrame, key: str = "doc_id") -> dict[str, dict[str, float]]:
    """Word counts by labelled language over a bounded sample: about SAMPLE_DOCS documents a language, chosen by the
    hash of their id, and of their words the SAMPLE_WORDS most frequent."""
    labels = [r[0] for r in documents.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LABELS).collect()]
    named = {x: n for x in labels if (n := label_notation(x)) in LANGUAGES}
    if not named:
        return {}
    mapped = F.create_map(*[F.lit(v) for pair in named.items() for v in pair])
    labelled = documents.select(F.xxhash64(key).alias("h"), mapped[F.col("lang")].alias("language"), "text").where(F.col("language").isNotNull())
    sizes = {r["language"]: r["count"] for r in labelled.groupBy("language").count().collect()}
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, SAMPLE_DOCS / n))])
    picked = labelled.where((F.col("h") / F.lit(2.0**64) + 0.5) < share[F.col("language")])

    def words(batches):
        for b in batches:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for _, line, _ in prose_lines(text):
                    for w in line:
                        if len(w) <= SAMPLE_LETTERS:
                            counts[lang, w] += 1
            if counts:
                yield pa.record_batch([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], names=["language", "word", "n"])

    rows = picked.select("language", "text").mapInArrow(words, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "language", "word").limit(SAMPLE_WORDS).collect()
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r["language"], {})[r["word"]] = float(r["n"])
    return out


def stretches(text: str | None, model: Unigrams) -> list[tuple[int, str, float, int, int, int]]:
    """(seg_no, language, confidence, first line, last line, characters of prose) of a text."""
    lines = prose_lines(text)
    if not lines:
        return []
    scores = model.scores([words for _, words, _ in lines])
    shares = np.exp(scores - scores.max(axis=1, keepdims=True))
    shares /= shares.sum(axis=1, keepdims=True)
    pick = shares.argmax(axis=1)
    sure = shares.max(axis=1) >= UNSURE
    for i in range(len(pick)):
        if not sure[i]:
            near = [pick[i - 1]] if i else [pick[k] for k in range(i + 1, len(pick)) if sure[k]][:1]
            if near and shares[i][near[0]] > 0.02:
                pick[i] = near[0]
    out, start = [], 0
    for i in range(1, len(pick) + 1):
        if i == len(pick) or pick[i] != pick[start]:
            total = scores[start:i].sum(axis=0)
            odds = np.exp(total - total.max())
            out.append((len(out), LANGUAGES[pick[start]], float(odds[pick[start]] / odds.sum()), lines[start][0] + 1, lines[i - 1][0] + 1, sum(x[2] for x in lines[start:i])))
            start = i
    return out


STRETCHES = "doc_id long, seg_no int, lang string, confidence double, first_line int, last_line int, n_chars int, label string, main_lang string, n_langs int"


def identify(documents: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """STRETCHES of all documents; label is the language the document's label names (null when missing), main_lang
    the language with most characters of prose, n_langs the number of languages in the document."""
    model = fit(sample_counts(documents, key), vocabulary(path))
    held = documents.sparkSession.sparkContext.broadcast(model.pieces)  # bounded by the vocabulary

    def run(batches):
        local = Unigrams(held.value)
        schema = pa.schema([("doc_id", pa.int64()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("n_chars", pa.int32()), ("label", pa.string()), ("main_lang", pa.string()), ("n_langs", pa.int32())])
        for b in batches:
            out = []
            for doc, label, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = stretches(text, local)
                size: dict[str, int] = defaultdict(int)
                for s in found:
                    size[s[1]] += s[5]
                main = max(size, key=lambda x: (size[x], -LANGUAGES.index(x)), default=None)
                out += [(doc, *s, label_notation(label), main, len(size)) for s in found]
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return spread_scan(documents.select(F.col(key).cast("long").alias("doc_id"), F.col("lang").alias("label"), "text")).mapInArrow(run, STRETCHES)


def to_correct(found: DataFrame) -> DataFrame:
    """The stretches of documents whose label is missing or wrong, or that hold more than one language."""
    return found.where(F.col("label").isNull() | (F.col("label") != F.col("main_lang")) | (F.col("n_langs") > 1))
