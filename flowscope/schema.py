"""Schemas, the code vocabularies and the fixed 519-column feature layout."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: TLS code vocabularies, as inclusive ranges -------------------------------------
CIPHER_RANGES = [
    (0x0000, 0x001B),
    (0x001E, 0x0046),
    (0x0067, 0x006D),
    (0x0084, 0x00C7),
    (0x00FF, 0x00FF),
    (0x1301, 0x1305),
    (0x5600, 0x5600),
    (0xC001, 0xC0B5),
    (0xC100, 0xC106),
    (0xCCA8, 0xCCAE),
    (0xD001, 0xD003),
    (0xD005, 0xD005),
]
SIGNATURE_RANGES = [
    (0x0201, 0x0201),
    (0x0203, 0x0203),
    (0x0401, 0x0401),
    (0x0403, 0x0403),
    (0x0420, 0x0420),
    (0x0501, 0x0501),
    (0x0503, 0x0503),
    (0x0520, 0x0520),
    (0x0601, 0x0601),
    (0x0603, 0x0603),
    (0x0620, 0x0620),
    (0x0704, 0x0709),
    (0x070A, 0x070F),
    (0x0804, 0x080B),
    (0x081A, 0x081C),
]
# Columns of this range carry upper-case hex digits. Codes are formatted in lower case, so they never
# reach these columns: the six stay 0 and the codes count as reserved (GREASE) values.
SIGNATURE_UPPER = (0x070A, 0x070F)
GROUP_RANGES = [(1, 41), (256, 260), (65281, 65282)]
POINT_RANGES = [(0, 2)]
EXTENSION_RANGES = [(0, 53), (55, 56), (65281, 65281)]

OSINT_COLUMNS = [
    "dom_in_tranco_1m",
    "dom_dga_prob",
    "otx_status",
    "otx_age",
    "urlhaus_status",
    "urlhaus_age",
    "ja3_urlhaus_status",
    "ja3_urlhaus_age",
]
# feature column -> client hello field
CLIENT_SCALARS = {
    "tls_record_type": "Type",
    "client_tls_ver": "Version",
    "message_len": "MessageLen",
    "handshake_type": "HandshakeType",
    "handshake_version": "HandshakeVersion",
    "handshake_len": "HandshakeLen",
    "cs_len": "CipherSuiteLen",
    "ext_len": "ExtensionLen",
    "src_port": "SrcPort",
    "dst_port": "DstPort",
}
SERVER_SCALARS = ["svr_ocsp_staple", "svr_tls_ver", "svr_supported_ver"]
LABEL = "malware_label"
# --- end of fixed values ---------------------------------------------------------------------------


def expand(ranges: list[tuple[int, int]]) -> list[int]:
    return [code for low, high in ranges for code in range(low, high + 1)]


CIPHER_CODES = expand(CIPHER_RANGES)
SIGNATURE_CODES = expand(SIGNATURE_RANGES)
GROUP_CODES = expand(GROUP_RANGES)
POINT_CODES = expand(POINT_RANGES)
EXTENSION_CODES = expand(EXTENSION_RANGES)

# what a formatted code can actually match
SIGNATURE_MATCHED_RANGES = [r for r in SIGNATURE_RANGES if r != SIGNATURE_UPPER]


def cipher_column(code: int) -> str:
    return f"cs_{code:04x}"


def signature_column(code: int) -> str:
    low, high = SIGNATURE_UPPER
    return f"sig_{code:04X}" if low <= code <= high else f"sig_{code:04x}"


def group_column(code: int) -> str:
    return f"grp_{code:02d}"


def point_column(code: int) -> str:
    return f"pts_{code:02d}"


def extension_column(code: int) -> str:
    return f"svr_ext_{code:02d}"


CIPHER_COLUMNS = [cipher_column(c) for c in CIPHER_CODES] + ["cs_unknown"]
SIGNATURE_COLUMNS = [signature_column(c) for c in SIGNATURE_CODES] + ["sig_grease", "sig_empty"]
GROUP_COLUMNS = [group_column(c) for c in GROUP_CODES] + ["grp_grease"]
POINT_COLUMNS = [point_column(c) for c in POINT_CODES]
EXTENSION_COLUMNS = [extension_column(c) for c in EXTENSION_CODES] + ["svr_ext_unassigned"]
CODE_COLUMNS = CIPHER_COLUMNS + SIGNATURE_COLUMNS + GROUP_COLUMNS + POINT_COLUMNS + EXTENSION_COLUMNS

FEATURE_COLUMNS = OSINT_COLUMNS + list(CLIENT_SCALARS) + CODE_COLUMNS + SERVER_SCALARS + [LABEL]

ENDPOINT_KEYS = ["SrcIP", "SrcPort", "DstIP", "DstPort"]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CLIENT_HELLO = _strings(
    "SrcIP", "SrcPort", "DstIP", "DstPort", "SNI", "Ja3", "Type", "Version", "MessageLen", "HandshakeType",
    "HandshakeVersion", "HandshakeLen", "CipherSuiteLen", "ExtensionLen", "CipherSuites", "SignatureAlgs",
    "SupportedGroups", "SupportedPoints",
)
SERVER_HELLO = _strings(
    "SrcIP", "SrcPort", "DstIP", "DstPort", "Version", "SupportedVersion", "OCSPStapling", "SelectedGroup",
    "CipherSuite", "Extensions",
)
BLACKLIST = _strings("ja3", "first_seen", "last_seen", "reason")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


OTX_GENERAL = _struct(pulse_info=_struct(pulses=T.ArrayType(_strings("id"))))
OTX_DNS = _struct(passive_dns=T.ArrayType(_strings("first", "last")))
OTX_REPORT = _struct(ip=T.StringType(), general=OTX_GENERAL, passive_dns=OTX_DNS)
URLHAUS_REPORT = _struct(
    host=T.StringType(),
    query_status=T.StringType(),
    firstseen=T.StringType(),
    urls=T.ArrayType(_strings("url_status")),
)
POPULARITY = _struct(list_date=T.DateType(), rank=T.IntegerType(), domain=T.StringType())
FEATURE_TABLE = T.StructType(
    [T.StructField(c, T.IntegerType() if c == LABEL else T.DoubleType()) for c in FEATURE_COLUMNS]
)
