"""SentencePiece encoding and decoding, exact for merge-type models, by backtracking over longest matches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
# Chunks of a text and pairs of tokens that a worker remembers at most; a full table is emptied.
MEMO = 1 << 18
# Rows whose results are held before they are sent on.
SOME = 512
# Longer chunks are not remembered.
MEMO_CHARS = 48
# Below all scores: nothing takes up a whole token.
NEVER = float("-inf")

_models: dict[bytes, "Pieces"] = {}


class _Chunks(dict):
    """Ids of chunks as bytes. A missing one is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = ids
        return ids


class Pieces:
    """A vocabulary of pieces with merge priorities.

    Read from a model file: pieces, scores and their kinds. Texts are taken as they are, white space included, with
    one space put before the first character; unknown characters fall back to byte pieces. A model that normalises
    otherwise, or that has no byte pieces, raises ValueError.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)) or sum(sp.is_byte(i) for i in range(n)) != 256:
            raise ValueError("a model with byte pieces and without unused pieces is needed")
        probe = "  ﬁ Á  b\t"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model's normalisation is not supported")
        self.bos, self.eos = self._id(sp.bos_id()), self._id(sp.eos_id())
        self.byte_ids = [self._id(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.score = {p: sp.get_score(i) for i, p in enumerate(names) if not special[i]}
        self.id_of = {p: self._id(i) for i, p in enumerate(names) if not special[i]}
        # Decoding: bytes of an id; those of byte pieces may have to be checked.
        self.surface = [" ⁇ ".encode() if sp.is_unknown(i) else b"" if sp.is_control(i) else bytes([int(p[3:5], 16)])
                        if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.is_control = [sp.is_control(i) for i in range(n)]
        # A token never spans two characters that stand side by side in no piece: texts are cut before a run of spaces,
        # if spaces only lead pieces, and around characters that stand beside none.
        inside = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        beside = "".join(re.escape(c) for c in sorted({c for x in inside for c in x} - {SPACE}))
        leads = all(x[0] == SPACE or x[1] != SPACE for x in inside)
        self.chunk = re.compile(f"{SPACE}*[{beside}]+|{SPACE}+|[^{SPACE}{beside}]+" if leads and beside else r"[\s\S]+")
        self.search = ahocorasick.Automaton()
        for p in self.score:
            self.search.add_word(p, p)
        self.search.make_automaton()
        # The next shorter token that starts like a token; at last its first character, be it a piece or not.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.score), p[0])
                        for p in self.score if len(p) > 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, float]] | None] = {}
        self.chunks = _Chunks(self._encode_chunk)

    @staticmethod
    def _id(i: int) -> bytes:
        return i.to_bytes(4, "little")

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, int]]]:
        """Tokens by merging: always the pair with the highest score, of equal ones the leftmost. And what was done:
        scores, and -1 where the first token was part of it, 1 the last, 2 both, 0 none."""
        parts, done = list(text), []
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            done.append((best, (2 if len(parts) == 2 else -1) if at == 0 else 1 if at == len(parts) - 2 else 0))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts, done

    def edge(self, token: str, side: int) -> list[tuple[str, float]] | None:
        """How the first (-1) or last (1) character of a token grows by merging: what stands at that end, and the score
        of the merge that takes it up; of the whole token, none. None where merging does not give the token, or not in
        falling order of scores."""
        known = self.edges.get((token, side), 0)
        if known == 0:
            parts, done = self.merged(token)
            falling = all(a[0] >= b[0] for a, b in zip(done, done[1:]))
            known = None
            if len(parts) == 1 and falling:
                known, now = [], list(token)
                for s, where in done:
                    at = next(i for i in range(len(now) - 1) if self.score.get(now[i] + now[i + 1]) == s)
                    if where == side or where == 2:
                        known.append((now[0] if side < 0 else now[-1], s))
                    now[at:at + 2] = [now[at] + now[at + 1]]
                known.append((token, NEVER))
            self.edges[token, side] = known
        return known

    def compatible(self, last: str, token: str) -> bool:
        """Whether the two tokens side by side are what merging makes of their text.

        Both are merged again from their characters in step, in the order of scores, as far as their ends that meet are
        concerned. They stay apart if no merge over the border ever comes first: of equal scores the left one does.
        """
        left, right = self.edge(last, 1) if last else None, self.edge(token, -1)
        if not last:
            return right is not None or self.merged(token)[0] == [token]
        if left is None or right is None:
            return self.merged(last + token)[0] == [last, token]
        score, i, j = self.score, 0, 0
        while True:
            x, of_x = left[i]
            y, of_y = right[j]
            over = score.get(x + y)
            if over is not None and over > of_x and over >= of_y:
                return False
            if of_x >= of_y:
                if of_x == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def fits(self, last: str, token: str) -> bool:
        """``compatible``, remembered."""
        pair = (last, token)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[pair] = self.compatible(last, token)
        return known

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text. At every position the longest token that fits its left neighbour is taken; where none
        fits, the position is marked as failed and the token before gives way to a shorter one. Neighbours that fit
        pairwise are the one encoding, so a failed position can never be a border."""
        longest = list(text)
        for end, piece in self.search.iter(text):
            longest[end - len(piece) + 1] = piece  # of those that start here, later ones are longer
        n, pos, out = len(text), 0, []
        open_ = (1 << (n + 1)) - 1 if n < 512 else None
        failed = bytearray(n + 1) if open_ is None else None
        token = longest[0] if text else None
        while pos < n:
            last = out[-1] if out else ""
            end = pos + len(token)
            while True:
                free = open_ >> end & 1 if failed is None else not failed[end]
                if free and self.fits(last, token):
                    out.append(token)
                    pos = end
                    if pos < n:
                        token = longest[pos]
                    break
                if len(token) > 1:
                    token = self.shorter[token]
                    end = pos + len(token)
                    continue
                if failed is None:
                    open_ &= ~(1 << pos)
                else:
                    failed[pos] = 1
                token = out.pop()
                pos -= len(token)
                break
        return out

    def _ids(self, token: str) -> bytes:
        known = self.id_of.get(token)
        return known if known is not None else b"".join([self.byte_ids[b] for b in token.encode()])

    def _encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._ids, self.tokens(chunk)))

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids = b""
        if text:
            ids = b"".join(map(self.chunks.__getitem__, self.chunk.findall(SPACE + text.replace(" ", SPACE))))
        return (self.bos if bos else b"") + ids + (self.eos if eos else b"")

    def decode(self, ids: bytes) -> str:
        """Text of ids. The space before the first piece goes; a byte that is no part of a character becomes U+FFFD."""
        numbers = memoryview(ids).cast("I").tolist()
        first = next((i for i in numbers if not self.is_control[i]), None)
        raw = b"".join(map(self.surface.__getitem__, numbers))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_odd(numbers)
        lead = first is not None and not self.is_byte[first] and self.surface[first][:1] == b" " and self.surface[first] != self.surface[0]
        return text[1:] if lead else text

    def _decode_odd(self, numbers: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*numbers, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for k in (4, 3, 2, 1):
                    try:
                        out.append(bytes(run[:k]).decode())
                        if len(out[-1]) == 1:
                            break
                        out.pop()
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k = 1
                del run[:min(k, len(run))]
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


def pieces_of(model: bytes) -> Pieces:
    """The vocabulary of a model file's content, made once a worker."""
    key = hashlib.sha256(model).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(model)
    return _models[key]


def _mapped(df: DataFrame, source: str, added: list[T.StructField], model_path: str, work) -> DataFrame:
    with open(model_path, "rb") as f:
        model = f.read()
    pieces_of(model)  # an unfit model fails here, not in a task
    new = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in new]
    out = T.StructType([*kept, *added])
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces_of(model)
        for whole in batches:
            for at in range(0, whole.num_rows, SOME):
                b = whole.slice(at, SOME)
                made = [work(found, v.as_py()) for v in b.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(zip(*made), kinds))],
                                                 names=[f.name for f in out.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias("_in")).mapInArrow(run, out)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", bos: bool = True,
                     eos: bool = True, decoded: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``ids``, which replaces a column of that name: the token ids of the whole text as
    little-endian unsigned 32-bit integers in a binary. With a name for ``decoded`` also the text decoded from these ids.

    The model file is read once, by the driver, and travels with the tasks. A null text is an empty one: of it only the
    begin and end ids remain. Each row is encoded by itself: repeated rows stay, an empty table gives an empty one.
    """
    added = [T.StructField(ids, T.BinaryType(), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])

    def work(found: Pieces, value: str | None) -> tuple:
        got = found.encode(value or "", bos, eos)
        return (got, found.decode(got)) if decoded else (got,)

    return _mapped(docs, text, added, model_path, work)


def decode_documents(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and ``text``, which replaces a column of that name: the text that the ids of column
    ``ids`` (as ``encode_documents`` makes them) stand for. Null ids give an empty text."""
    return _mapped(docs, ids, [T.StructField(text, T.StringType(), False)], model_path,
                   lambda found, value: (found.decode(value or b""),))
