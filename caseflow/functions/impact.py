"""Cost, CO2 and cache-key arithmetic for tool and model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price in USD per token, CO2 in grams per 1000 tokens, other factors and tool groups.
TOOL_MODEL_FACTORS = {
    "claude-3-5-sonnet": (3.0e-6, 15.0e-6, 0.5),
    "gpt-4": (30.0e-6, 60.0e-6, 8.5),
    "gpt-3.5-turbo": (0.5e-6, 1.5e-6, 1.2),
}
TOOL_MODEL_DEFAULT = (0.5e-6, 1.5e-6, 2.0)
CALL_MODEL_FACTORS = {
    "claude-3-5-sonnet-20241022": (3.0e-6, 15.0e-6, 0.5),
    "gpt-4": (30.0e-6, 60.0e-6, 8.5),
    "gpt-3.5-turbo": (0.5e-6, 1.5e-6, 1.2),
}
CALL_MODEL_DEFAULT = (1.0e-6, 2.0e-6, 2.0)
CPU_SECOND = (0.0001, 0.8)
STORAGE_MB = (0.00001, 0.05)
HEAVY_TOOLS = ["train_lr", "eval", "split", "profile"]
HEAVY_FACTOR = 10
STORAGE_TOOLS = ["read_csv", "write_file", "write_json", "zip"]
TOOL_CATEGORIES = {
    "data": ["read_csv", "write_file", "write_json", "profile"],
    "ml": ["train_lr", "eval", "split"],
    "processing": ["zip", "verify_zip"],
    "reporting": ["emit_report"],
    "system": ["build_cli", "verify_cli"],
    "model": ["generate", "plan", "analyze"],
}


def _factor(model: Column, table: dict, default: tuple, pos: int) -> Column:
    out = F.lit(default[pos])
    for name, factors in table.items():
        out = F.when(model == name, F.lit(factors[pos])).otherwise(out)
    return out


def tool_category(tool: Column) -> Column:
    out = F.lit("other")
    for name, tools in TOOL_CATEGORIES.items():
        out = F.when(tool.isin(tools), F.lit(name)).otherwise(out)
    return out


def tool_impact(tool: Column, latency_ms: Column, tokens: Column, model: Column, io_chars: Column) -> Column:
    """struct(cost_usd, co2_grams): model tokens split 70/30, CPU time, storage volume."""
    uses_model = model.isNotNull() & (tokens > 0)
    tokens_in = F.floor(tokens * 0.7)
    m_cost = tokens_in * _factor(model, TOOL_MODEL_FACTORS, TOOL_MODEL_DEFAULT, 0) + (
        tokens - tokens_in
    ) * _factor(model, TOOL_MODEL_FACTORS, TOOL_MODEL_DEFAULT, 1)
    m_co2 = tokens / 1000.0 * _factor(model, TOOL_MODEL_FACTORS, TOOL_MODEL_DEFAULT, 2)
    cpu = latency_ms / 1000.0 * F.when(tool.isin(HEAVY_TOOLS), HEAVY_FACTOR).otherwise(1)
    mb = F.when(tool.isin(STORAGE_TOOLS), F.greatest(F.lit(0.01), io_chars / (1024.0 * 1024.0))).otherwise(0.0)
    zero = F.lit(0.0)
    return F.struct(
        (F.when(uses_model, m_cost).otherwise(zero) + cpu * CPU_SECOND[0] + mb * STORAGE_MB[0]).alias("cost_usd"),
        (F.when(uses_model, m_co2).otherwise(zero) + cpu * CPU_SECOND[1] + mb * STORAGE_MB[1]).alias("co2_grams"),
    )


def estimate_tokens(text: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def model_call_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """struct(cost_usd, co2_grams) of one model call."""
    cost = tokens_in * _factor(model, CALL_MODEL_FACTORS, CALL_MODEL_DEFAULT, 0) + tokens_out * _factor(
        model, CALL_MODEL_FACTORS, CALL_MODEL_DEFAULT, 1
    )
    co2 = (tokens_in + tokens_out) / 1000.0 * _factor(model, CALL_MODEL_FACTORS, CALL_MODEL_DEFAULT, 2)
    return F.struct(cost.alias("cost_usd"), co2.alias("co2_grams"))


def content_key(model: Column, inputs: dict[str, Column]) -> Column:
    """sha256 of the model name and the inputs as compact JSON with sorted keys."""
    body = F.to_json(F.struct(*[inputs[k].alias(k) for k in sorted(inputs)]))
    return F.sha2(F.concat(model, F.lit(":"), body), 256)


def application_id(path: Column) -> Column:
    """First twelve hex digits of the sha256."""
    return F.substring(F.sha2(path, 256), 1, 12)


def impact_tier(cost_usd: Column, co2_grams: Column) -> Column:
    return (
        F.when((co2_grams < 1) & (cost_usd < 0.01), "minimal")
        .when((co2_grams < 10) & (cost_usd < 0.1), "moderate")
        .otherwise("significant")
    )
