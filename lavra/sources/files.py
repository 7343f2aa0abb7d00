"""Files, uploads and addresses as sources: suffixes, signatures, hashes, public addresses.

Defined results: null names, contents and addresses are refused with a reason or give null; empty folders and tables
give no row.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

# Media types by the first bytes of a file, in hexadecimal.
SIGNATURES = (
    ("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"),
    ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("49492B00", "image/tiff"), ("4D4D002B", "image/tiff"), ("424D", "image/bmp"),
)
# Suffixes of files that are taken, with the media type each stands for.
SUFFIXES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp"}
# Endings of host names that are not public, and query parameters that carry secrets.
LOCAL_HOSTS = ("localhost", ".localhost", ".local", ".internal", ".lan", ".home")
SECRETS = {
    "token", "access_token", "api_key", "key", "secret", "signature", "sig", "password", "authorization", "credential", "x_amz_signature", "x_amz_credential",
    "apikey", "auth", "auth_token", "bearer", "client_secret", "jwt", "session_token",
}
MAX_BYTES, MAX_URL = 50_000_000, 2048


def media_type(content: Column) -> Column:
    """Media type by signature; null for anything else, HTML included."""
    start = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for prefix, media in reversed(SIGNATURES):
        out = F.when(start.startswith(prefix), media).otherwise(out)
    return out


def suffix_type(name: Column) -> Column:
    """The media type that a file's suffix stands for; null where it is none of the accepted ones."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for ending, media in SUFFIXES.items():
        out = F.when(suffix == ending, media).otherwise(out)
    return out


def refusal(name: Column, size: Column, content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is refused: suffix, emptiness, size, signature, or a signature that contradicts the suffix; null where it is taken."""
    return (
        F.when(suffix_type(name).isNull(), "suffix")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(size > max_bytes, "size")
        .when(media_type(content).isNull(), "signature")
        .when(media_type(content) != suffix_type(name), "type")
    )


def scan_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size_bytes, sha256, media_type) of the accepted files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sized = files.where((F.col("length") > 0) & (F.col("length") <= max_bytes) & suffix_type(F.col("path")).isNotNull())
    taken = sized.where(refusal(F.col("path"), F.col("length"), F.col("content"), max_bytes).isNull())
    return taken.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), media_type(F.col("content")).alias("media_type"))


def accept_uploads(uploads: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``uploads`` (name, content) with size_bytes, sha256, media_type and why each is refused, if it is."""
    size = F.octet_length("content")
    return uploads.select(
        "name", size.alias("size_bytes"), F.sha2("content", 256).alias("sha256"), media_type(F.col("content")).alias("media_type"), refusal(F.col("name"), size, F.col("content"), max_bytes).alias("refused")
    )


def canonical_url(url: str | None) -> str | None:
    """The canonical form of a public http(s) address, without fragment; None where it is none.

    No user names, ports other than the default ones, local or private hosts, or secrets in the query; names in other
    scripts come out in their ASCII form.
    """
    text = (url or "").strip()
    if not 0 < len(text) <= MAX_URL or re.search(r"[\s\x00-\x1f\\]", text):
        return None
    try:
        parts = urlsplit(text)
        scheme, host, port = parts.scheme.lower(), parts.hostname, parts.port
        if scheme not in ("http", "https") or not host or "%" in host or parts.username is not None or parts.password is not None:
            return None
        host = host if ":" in host else host.encode("idna").decode("ascii").lower().rstrip(".")
        if port not in (None, 443 if scheme == "https" else 80):
            return None
        if host == LOCAL_HOSTS[0] or host.endswith(LOCAL_HOSTS[1:]):
            return None
        if ":" in host or re.fullmatch(r"[0-9.]+", host):
            address = ipaddress.ip_address(host)
            address = getattr(address, "ipv4_mapped", None) or address
            if not address.is_global or address.is_multicast or address.is_reserved:
                return None
        names = {name.lower().replace("-", "_") for name, _ in parse_qsl(parts.query, keep_blank_values=True)}
    except (ValueError, UnicodeError):
        return None
    return None if names & SECRETS else urlunsplit((scheme, f"[{host}]" if ":" in host else host, parts.path or "/", parts.query, ""))


@F.pandas_udf(StringType())
def _canonical_urls(urls: pd.Series) -> pd.Series:
    known = {u: canonical_url(u) for u in urls.dropna().unique()}
    return urls.map(lambda u: None if u is None else known[u])


def public_address(url: Column) -> Column:
    """``canonical_url`` as a column; the rules of names in other scripts and of address ranges need Python."""
    return _canonical_urls(url)


def merge_references(*maps: Column) -> Column:
    """References by name, the later map winning, without those that are no public address."""
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps]))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))
