"""Fixed schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


RULE = _struct(rule_id=S, text=S, parent_id=S, content_hash=S)

_FACE = _struct(oracle_text=S, power=S, toughness=S, loyalty=S, image_uris=_struct(normal=S))
RAW_CARD = _struct(
    oracle_id=S, name=S, oracle_text=S, type_line=S, mana_cost=S, scryfall_uri=S, power=S, toughness=S,
    loyalty=S, image_uris=_struct(normal=S), card_faces=T.ArrayType(_FACE),
)
CARD = _struct(
    oracle_id=S, name=S, oracle_text=S, type_line=S, mana_cost=S, scryfall_uri=S, power=S, toughness=S,
    loyalty=S, image_uri=S, content_hash=S,
)
RAW_RULING = _struct(oracle_id=S, published_at=S, comment=S)
RULING = _struct(oracle_id=S, published_at=S, comment=S, content_hash=S)

INGESTION_RUN = _struct(source=S, started_at=TS, finished_at=TS, record_count=L, raw_path=S, parsed_path=S)

# Union of the payload fields of the three kinds of chunk.
PAYLOAD = _struct(
    source_type=S, content_hash=S, text=S, rule_id=S, section_id=S, section_title=S, card_name=S,
    oracle_id=S, published_at=S, scryfall_uri=S,
)
CHUNK = _struct(point_id=S, source_type=S, text_to_embed=S, content_hash=S, payload=PAYLOAD)
SPARSE = _struct(indices=T.ArrayType(L), values=T.ArrayType(D))
POINT = _struct(
    point_id=S, source_type=S, content_hash=S, payload_hash=S, payload=PAYLOAD,
    dense=T.ArrayType(T.FloatType()), sparse=SPARSE,
)

LEDGER = _struct(
    id=L, created_at=TS, ip_bucket=S, is_admin=B, outcome=S, model=S, input_tokens=L, output_tokens=L,
    thinking_tokens=L, cost_usd=D,
)

STREAM_EVENT = _struct(stream_id=S, seq=L, ts=TS, event=S, data=S)
