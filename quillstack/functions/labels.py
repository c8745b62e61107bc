"""Labels shown for names that the engine uses; a name without a label shows itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by name.
CHECK = {
    "chunk_embedding_pairing": "分块-向量对应关系",
    "dimension_consistency": "向量维度一致性",
    "sequence_continuity": "序号连续性",
    "chunk_text_availability": "分块文本可读性",
    "contextualized_text_availability": "上下文增强文本可读性",
    "token_count_consistency": "Token 数有效性",
    "model_consistency": "嵌入模型一致性",
}
STATUS = {"succeeded": "已完成", "queued": "排队中", "running": "运行中", "failed": "失败", "cancelled": "已取消", "superseded": "已更新"}
SOURCE = {"inline": "内联", "file": "文件"}
SOURCE_UNKNOWN = "不可用"
ROLE = {"system": "System", "user": "User", "assistant": "Assistant"}


def label(name: Column, labels: dict[str, str], unknown: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), name)
    return F.coalesce(found, name if unknown is None else F.lit(unknown))


def status_colour(status: Column) -> Column:
    return F.when(status == "succeeded", "good").when(status == "failed", "bad").when(status.isin("queued", "running"), "open").otherwise("neutral")
