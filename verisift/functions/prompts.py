"""Prompts of the decision and of the final answer, as native expressions.

A template is cut at its placeholders on the driver and put together again around the values, so that
a value that itself holds a placeholder stays as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisift.functions.text import strip

KNOWLEDGE, STATEMENT = "[KNOWLEDGE]", "[STATEMENT]"

# The templates models are asked with, and the hints added to them.
DECISION_TEMPLATE = """\
Instructions:
1. You are provided with a STATEMENT and relevant KNOWLEDGE points.
2. Based on the KNOWLEDGE, assess the factual accuracy of the STATEMENT.
3. Before presenting your conclusion, think through the process step-by-step. 
   Include a summary of the key points from the KNOWLEDGE as part of your reasoning.
4. If the KNOWLEDGE allows you to confidently make a decision, output the final 
   answer as a JSON object in the following format:
   {
     "final_answer": "True" or "False"
   }
5. If the KNOWLEDGE is insufficient to make a judgment, issue ONE Google Search 
   query that could provide additional evidence. Output the search query in JSON 
   format, as follows:
   {
     "search_query": "Your Google search query here"
   }
6. The query should aim to obtain new information not already present in the 
   KNOWLEDGE, specifically helpful for verifying the STATEMENT's accuracy.

KNOWLEDGE:
[KNOWLEDGE]

STATEMENT:
[STATEMENT]
"""
FINAL_TEMPLATE = """\
Instructions:
1. You are provided with a STATEMENT and relevant KNOWLEDGE points.
2. Based on the KNOWLEDGE, assess the factual accuracy of the STATEMENT.
3. Before presenting your final answer, think step-by-step and show your reasoning. 
   Include a summary of the key points from the KNOWLEDGE as part of your reasoning.
4. Your final answer should be either "True" or "False".
5. Format your final answer as a JSON object in the following structure:
   {
     "final_answer": "True" or "False"
   }

KNOWLEDGE:
[KNOWLEDGE]

STATEMENT:
[STATEMENT]
"""
DIVERSE_HINT = (
    "Please pay attention to optimizing the query to make it more diverse and the retrieved knowledge is as "
    "different as possible."
)
EVIDENCE_HINT = (
    "\n\nPlease note! We have detected multiple very similar contents in the Knowledge section. Please optimize "
    "your query so that the retrieved knowledge is as different as possible."
)
QUERY_HINT = (
    "\nPlease note that we have detected very similar content many times in the past query history. Please pay "
    "attention to optimizing the query to make it more diverse."
)
#: What stands for knowledge in the decision prompt while there is none.
NO_KNOWLEDGE = "N/A"


def fill(template: str, claim: Column, knowledge: Column) -> Column:
    """``template`` with its placeholders replaced in one pass, stripped."""
    values = {KNOWLEDGE: knowledge, STATEMENT: claim}
    parts = re.split(r"(\[KNOWLEDGE\]|\[STATEMENT\])", template)
    return strip(F.concat(*[values[p] if p in values else F.lit(p) for p in parts if p]))


def knowledge(results: Column, empty: str = NO_KNOWLEDGE) -> Column:
    """Results of the searches so far, a line each; ``empty`` where that gives no text."""
    return F.coalesce(F.nullif(F.array_join(results, "\n"), F.lit("")), F.lit(empty))


def decision_prompt(claim: Column, results: Column, template: str = DECISION_TEMPLATE) -> Column:
    """The prompt that asks for a verdict or one search query."""
    return fill(template, claim, knowledge(results))


def final_prompt(claim: Column, results: Column, template: str = FINAL_TEMPLATE) -> Column:
    """The prompt that asks for a verdict; no knowledge is no text here."""
    return fill(template, claim, knowledge(results, ""))


def hints(queries: Column, similar_evidence: Column, similar_queries: Column) -> Column:
    """The hints that follow a decision prompt: the first from two queries on, the others by flags."""
    return F.concat(
        F.when(F.size(queries) >= 2, DIVERSE_HINT).otherwise(""),
        F.when(similar_evidence, EVIDENCE_HINT).otherwise(""),
        F.when(similar_queries, QUERY_HINT).otherwise(""),
    )
