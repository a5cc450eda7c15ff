"""Message screening: override attempts and off-topic requests never pass.

A native regular-expression job over a table of messages. The same columns work on a
streaming table (see ``flowtrail.streaming``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Instruction-override families.
OVERRIDE_PATTERNS = (
    r"\bignore\s+(all\s+|any\s+|the\s+)?(previous|prior|earlier|above|your)\b",
    r"\bdisregard\s+(all\s+|any\s+|the\s+)?(previous|prior|earlier|above|your)\b",
    r"\bforget\s+(all\s+|everything\s+|your\s+|the\s+)?(you|instructions|rules|prompt|above)",
    r"\b(new|updated|revised)\s+(instructions?|rules?|prompt)\s*[:.\-]",
    r"\byou\s+are\s+now\s+(a|an|no longer)\b",
    r"\bpretend\s+(to\s+be|you\s+are|that\s+you)\b",
    r"\bact\s+as\s+(a|an|if\s+you)\b",
    r"\broleplay\b",
    r"\b(system|initial|original)\s+(prompt|instructions?|message)\b",
    r"\b(reveal|show|print|repeat|output|display)\s+(me\s+)?(your|the)\s+(prompt|instructions?|rules)\b",
    r"\b(developer|debug|god|admin)\s+mode\b",
    r"\bjailbreak\b",
    r"\bDAN\b",
    r"\bwithout\s+(any\s+)?(restrictions?|limits?|filters?|guardrails?)\b",
    r"\bdo\s+anything\s+now\b",
    r"\boverride\s+(your|the|all)\b",
    r"\bstop\s+being\b",
    r"\byour\s+(real|true|actual)\s+(instructions?|purpose|prompt)\b",
)

# Off-topic families.
OFF_TOPIC_PATTERNS = (
    r"\b(recipe|cook|bake|chocolate|cake|pizza)\b",
    r"\bwrite\s+(me\s+)?(a\s+)?(poem|song|story|essay|joke|rap)\b",
    r"\b(python|javascript|java|c\+\+|html|css|sql)\s+(code|script|function|program)\b",
    r"\bhomework\b",
    r"\b(weather|football|movie|lyrics|horoscope)\b",
    r"\btranslate\s+(this|the following|into)\b",
)


def _matches(text: Column, families: tuple[str, ...]) -> Column:
    # Case-insensitive with Unicode-aware classes and word boundaries.
    return F.coalesce(text.rlike("(?iU)" + "|".join(families)), F.lit(False))


def verdict(text: Column) -> Column:
    return (
        F.when(_matches(text, OVERRIDE_PATTERNS), "injection")
        .when(_matches(text, OFF_TOPIC_PATTERNS), "off_topic")
        .otherwise("pass")
    )


def screen(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.withColumn("verdict", verdict(F.col(text)))


def blocked_turns(screened: DataFrame) -> DataFrame:
    """Turns refused per conversation."""
    return screened.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("verdict") == "injection").alias("injection"),
        F.count_if(F.col("verdict") == "off_topic").alias("off_topic"),
    )
