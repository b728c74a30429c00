"""Prompt texts as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default prompt texts. The requests and the token budget depend on them word by
# word; every one can be replaced through ``Prompts``.
SYSTEM = """\
You are an expert log analysis assistant for Docker containers. Your role is to:

1. Analyze container logs for issues, errors, and anomalies
2. Identify security concerns or suspicious patterns
3. Detect performance problems or degradation
4. Distinguish between routine logs and actual problems

Focus on providing actionable insights. Ignore routine informational logs unless they reveal patterns.
Be concise and specific in your findings.
"""
ANALYSIS = """\
Analyze these {{.LogCount}} log entries from container "{{.ContainerName}}":

{{.Logs}}

Provide a structured analysis:
1. **Summary**: Brief overview of log activity
2. **Errors**: Any errors or exceptions found (be specific)
3. **Warnings**: Potential issues or concerns
4. **Recommendations**: Suggested actions if needed

If logs are routine with no issues, state "No significant issues detected."
"""
CHUNK_SUMMARY = """\
This is chunk {{.ChunkNum}} of {{.TotalChunks}} from container "{{.ContainerName}}".
Summarize the key findings from these logs. Focus on errors, warnings, and anomalies.
Be concise:

{{.Logs}}
"""
SYNTHESIS = """\
These are summaries from analyzing logs for container "{{.ContainerName}}" in multiple chunks.
Provide a final comprehensive analysis:

{{.Summaries}}

Final Analysis:
1. **Summary**: Overall findings across all chunks
2. **Critical Issues**: Most important errors or problems
3. **Patterns**: Any recurring issues or trends
4. **Recommendations**: Priority actions needed
"""
EXECUTIVE = """\
Generate a concise executive summary of this Docker log scan.

Analyzed {{.ContainerCount}} container(s):

{{.ContainerAnalyses}}

Create a brief executive summary (max 250 words) for notification delivery:

1. **Overall Status**: One-line health assessment
2. **Critical Issues**: List most urgent problems (if any)
3. **Action Required**: Yes/No and what action
4. **Affected Containers**: Which containers need attention

Keep it concise and actionable. Focus on what needs immediate attention.
"""
INSTRUCTIONS_HEADING = "\n\nUser Instructions for this container:\n"
SUMMARY_PART = "\n--- Chunk %d Summary ---\n%s\n"
ANALYSIS_PART = "### %s\n%s\n\n"

_FIELD = re.compile(r"\{\{-?\s*\.(\w+)\s*-?\}\}")


@dataclass(frozen=True)
class Prompts:
    system: str = SYSTEM
    analysis: str = ANALYSIS
    chunk_summary: str = CHUNK_SUMMARY
    synthesis: str = SYNTHESIS
    executive: str = EXECUTIVE


def render(template: str, **fields: Column) -> Column:
    """Fill ``{{.Field}}`` markers in one pass, so markers inside values stay as they are.

    A marker without a value raises ``KeyError``; any other template action ``ValueError``.
    """
    parts: list[Column] = []
    at = 0
    for marker in _FIELD.finditer(template):
        parts.append(F.lit(template[at:marker.start()]))
        if marker.group(1) not in fields:
            raise KeyError(f"template uses an unknown field {marker.group(1)!r}")
        parts.append(fields[marker.group(1)].cast("string"))
        at = marker.end()
    parts.append(F.lit(template[at:]))
    if "{{" in _FIELD.sub("", template):
        raise ValueError("template holds an unsupported action")
    return F.concat(*parts)


def system_prompt(prompts: Prompts, instructions: Column) -> Column:
    text = F.coalesce(instructions, F.lit(""))
    return F.when(text == "", F.lit(prompts.system)).otherwise(
        F.concat(F.lit(prompts.system), F.lit(INSTRUCTIONS_HEADING), text))


def analysis_prompt(prompts: Prompts, name: Column, logs: Column, count: Column) -> Column:
    return render(prompts.analysis, ContainerName=name, Logs=logs, LogCount=count)


def chunk_summary_prompt(prompts: Prompts, name: Column, number: Column, total: Column,
                         logs: Column) -> Column:
    return render(prompts.chunk_summary, ContainerName=name, ChunkNum=number, TotalChunks=total,
                  Logs=logs)


def synthesis_prompt(prompts: Prompts, name: Column, summaries: Column) -> Column:
    return render(prompts.synthesis, ContainerName=name, Summaries=summaries)


def executive_prompt(prompts: Prompts, count: Column, analyses: Column) -> Column:
    return render(prompts.executive, ContainerCount=count, ContainerAnalyses=analyses)


def summary_part(number: Column, summary: Column) -> Column:
    return F.format_string(SUMMARY_PART, number, summary)


def analysis_part(name: Column, analysis: Column) -> Column:
    return F.format_string(ANALYSIS_PART, name, analysis)
