"""Secret scan: fixed patterns plus dictionary-primed zstandard novelty.

Base spans come from three patterns (assignments, access keys, long hex runs).
The novelty scan looks at runs of key characters in a sensitive context (a word
such as *token* or *private* inside or within ``REACH`` code points before or
behind): zstandard is
primed with a dictionary of common identifiers and the text around the run, and
the run's marginal compressed bytes are taken.  Runs that the context and the
identifiers do not explain, byte for byte, are reported; nothing else rejects a
run, so a long word that the dictionary lacks may be reported.  Base spans always
stay; novelty only adds spans that overlap none of them.

Documents that cannot hold any span are told apart on their bytes first (no
keyword, no run of 32 hex digits), which changes no result.

Cases: null and empty texts have no span; repeated rows give the same result;
whole texts are read whatever their length.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import take, text_chunks

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
# A run adds at most its own bytes, so that a shorter one never has MIN_NOVEL.
_RUN = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
_SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[_-]?key|access[_-]?key|private|credential|bearer|auth|signature|pwd",
                        re.IGNORECASE | re.ASCII)
#: Bytes (lower case) of which one is in every text that has a keyword of either list.
_HINTS = (b"pass", b"secret", b"token", b"api", b"access", b"private", b"credential", b"bearer", b"auth", b"signature", b"pwd")
REACH = 48  # code points before and behind a run in which a sensitive word counts
AROUND = 256  # code points of context on each side that prime the compressor
MIN_NOVEL = 14  # marginal bytes
MIN_SHARE = 0.8  # marginal bytes by bytes
LEVEL = 19  # of zstandard; runs are short

#: Identifiers and endings that are no secrets although they stand near such words.
IDENTIFIERS = (
    "access_token refresh_token id_token client_secret client_id api_key apiKey private_key public_key secret_key "
    "access_key aws_access_key_id aws_secret_access_key authorization authentication credentials password passwd "
    "passphrase signature certificate bearer username user_name email localhost example.com https:// http:// www. "
    "application/json text/plain utf-8 base64 sha256 sha512 hmac rsa ecdsa ed25519 oauth oauth2 jwt session cookie "
    "header request response config configuration settings environment variable default production development "
    "function return import from class self this null None True False true false undefined const let var public "
    "private static final void string integer boolean object array list dict map value name type key id index path "
    "file directory .json .yaml .yml .toml .env .conf .cfg .ini .xml .html .py .js .ts .java .go .rs .c .cpp .h "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 12345678 xxxxxxxx XXXXXXXX "
    "1970-01-01T00:00:00Z 127.0.0.1 0.0.0.0 your_token_here changeme placeholder "
    "/usr/local/lib/python3/site-packages/ /usr/share/ /usr/bin/ /etc/ssl/certs/ /var/log/ /var/lib/ /home/ /opt/ /tmp/ "
    "/src/main/java/com/ /node_modules/ /include/ /public/ /images/ /api/v1/ /api/v2/ com.example. org.apache. "
    "service.internal server.request.handler .service.impl controller repository manager provider factory "
    "international responsibilities telecommunications administration organization information communication "
    "representative characteristic understanding development environmental government professional relationship "
    "institutional constitutional recommendation implementation infrastructure transportation pharmaceutical "
    "well-established self- counter under over inter trans super hyper micro multi electro psycho photo disestablish "
    "ization isation ational ability ibility fulness lessness ousness iveness mentally atically ically ological "
    "ologist ography ometer ments tions ities ings ement arianism anti dis non pre pro sub"
).encode()


def marginal_bytes(run: bytes, around: bytes) -> int:
    """Compressed bytes that ``run`` adds to what identifiers and context explain."""
    import zstandard as zstd

    primed = zstd.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    c = zstd.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False)
    return len(c.compress(run)) - len(c.compress(b""))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def novel_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs in sensitive context whose bytes neither identifiers nor context explain."""
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    if not words:
        return []
    covered = sorted((a, b) for _, a, b in taken)
    starts = [a for a, _ in covered]
    reach = np.maximum.accumulate([b for _, b in covered]) if covered else []  # spans of different kinds may overlap
    ends = np.array([b for _, b in words])
    out = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        run = m.group()
        k = int(np.searchsorted(ends, a - REACH))
        if k == len(words) or words[k][0] - b > REACH:
            continue
        i = int(np.searchsorted(starts, b))
        if i and reach[i - 1] > a:
            continue
        around = text[max(0, a - AROUND):a] + "\n" + text[b:b + AROUND]
        n = marginal_bytes(run.encode("utf-8", "surrogatepass"), around.encode("utf-8", "surrogatepass"))
        if n >= MIN_NOVEL and n >= MIN_SHARE * len(run):
            out.append(("novel", a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which documents may hold a span."""
    data = buf.tobytes()
    out = np.zeros(len(offs) - 1, bool)
    o = offs.tolist()
    for i in range(len(out)):
        t = data[o[i]:o[i + 1]]
        low = t.lower()
        out[i] = any(h in low for h in _HINTS) or b"AKIA" in t
    stops = np.flatnonzero(~(((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 102))))
    edge = np.concatenate(([-1], stops, [len(buf)]))
    long_run = np.flatnonzero(np.diff(edge) > 32)
    for a, b in zip((edge[long_run] + 1).tolist(), edge[long_run + 1].tolist()):
        i, j = np.searchsorted(offs, [a, b - 1], side="right") - 1
        out[i:j + 1] = True
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) by code point, end exclusive."""
    def run(batches):
        import pyarrow as pa
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for b in batches:
            spans: list[list[tuple[str, int, int]]] = [[] for _ in range(b.num_rows)]
            for i, _, buf, offs in text_chunks(b.column(1)):
                for k in np.flatnonzero(_suspects(buf, offs)).tolist():
                    text = buf[offs[k]:offs[k + 1]].tobytes().decode("utf-8", "replace")
                    base = base_spans(text)
                    spans[i + k] = base + novel_spans(text, base)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in s] for s in spans],
                                       pa.list_(kind))], ["doc_id", "spans"])

    src = take(docs, "doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")
