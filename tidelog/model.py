"""Schema, flags, limits, options and errors of the versioned entry log.

Order is user_key ascending by unsigned bytes, version descending. A snapshot
takes the newest version at or below its timestamp first and asks only then
whether that version is dead.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# fixed values: flag bits of ``meta``, limits and widths
DELETE, POINTER, DISCARD_EARLIER, MERGE_ENTRY, TXN, FIN_TXN = 1, 2, 4, 8, 64, 128
MAX_KEY_LENGTH = 65_000
MAX_VERSION = (1 << 63) - 1
POINTER_SIZE = 12
KEEP_ALL = MAX_VERSION

#: Keys under this prefix are the engine's own.
RESERVED_PREFIX = b"!tide!"

KV_SCHEMA = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("meta", T.IntegerType(), False),
        T.StructField("user_meta", T.IntegerType(), False),
        T.StructField("expires_at", T.LongType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
COLUMNS = KV_SCHEMA.fieldNames()


class KVError(Exception):
    """Base of all errors of the engine."""


class KeyNotFound(KVError): ...


class EmptyKey(KVError): ...


class TooLong(KVError): ...


class TxnTooBig(KVError): ...


class DiscardedTxn(KVError): ...


class DBClosed(KVError): ...


class ReadOnly(KVError): ...


class BadConfig(KVError): ...


class InvalidChecksum(KVError): ...


class InvalidFilename(KVError): ...


class ValueFileNotFound(KVError): ...


class InvalidValuePointer(KVError): ...


class InvalidLogOffset(KVError): ...


class WriteNoRoom(KVError): ...


class ReservedPrefix(KVError): ...


class Conflict(KVError):
    """The transaction read a key that a later commit has written; run it again."""


@dataclass(frozen=True)
class Options:
    """Settings of a store. Sizes are bytes. There are no memtables and no in-level tables to size, so
    there are no settings for them."""

    dir: str = ""
    value_dir: str = ""
    sync_writes: bool = False
    num_versions_to_keep: int = 1
    read_only: bool = False
    in_memory: bool = False
    mem_table_size: int = 64 << 20
    base_level_size: int = 10 << 20
    level_size_multiplier: int = 10
    table_size_multiplier: int = 2
    max_levels: int = 7
    value_threshold: int = 1024
    block_size: int = 4096
    bloom_false_positive: float = 0.01
    num_level_zero_tables: int = 5
    num_level_zero_tables_stall: int = 15
    value_log_file_size: int = 512 << 20
    value_log_max_entries: int = 1_000_000
    num_compactors: int = 4
    verify_checksums: bool = False
    detect_conflicts: bool = True
    managed_txns: bool = False
    create_if_not_exists: bool = True
    max_batch_count: int = 0
    max_batch_size: int = 0
    #: Rows of one key from which a compaction splits it over tasks.
    hot_key_rows: int = 5_000_000

    def fixed(self) -> Options:
        """These settings with what follows from others filled in, or BadConfig."""
        if self.num_versions_to_keep < 1:
            raise BadConfig("num_versions_to_keep starts at 1; KEEP_ALL keeps every version")
        if self.num_level_zero_tables_stall <= self.num_level_zero_tables:
            raise BadConfig("num_level_zero_tables_stall must exceed num_level_zero_tables")
        if not self.in_memory and not self.dir:
            raise BadConfig("a store on disk needs a dir")
        size = self.max_batch_size or self.mem_table_size * 15 // 100
        return replace(self, value_dir=self.value_dir or self.dir, sync_writes=self.sync_writes and not self.in_memory, max_batch_size=size, max_batch_count=self.max_batch_count or max(1, size // 64))

    def separates(self, size: int) -> bool:
        """Whether a value of ``size`` bytes is stored apart from its key."""
        return 0 < self.value_threshold <= size
