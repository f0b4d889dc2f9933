"""Fixed values that must equal the original pipeline's text for identical prompts.

Kept together and in their natural order; nothing here is logic.
"""

# Model prices per 1 000 tokens.
PRICE_PER_1K = {
    "gpt-4": 0.03,
    "gpt-3.5-turbo-0125": 0.0005,
}

# Prompt templates (section form). None = section part absent.
TEMPLATES = {
    "template_option_1": {
        "instruction": "### Complete sqlite SQL query only and with no explanation.",
        "demo_prefix": "### Some example pairs of question and corresponding SQL query are provided based on similar problems:",
        "demo_format": "### Answer the following question: {question}\n{query}",
        "demo_suffix": None,
        "demo_sep": "\n\n",
        "q_prefix": "### Given the following database schema:",
        "q_evidence": None,
        "q_body": "### Answer the following question: {question}",
        "q_suffix": "SELECT ",
        "q_sep": "\n\n",
        "section_sep": "\n\n",
        "max_tokens": 4096,
    },
    "template_option_2": {
        "instruction": "/* Complete sqlite SQL query only and with no explanation.*/",
        "demo_prefix": "/* Some example questions and corresponding SQL queries are provided based on similar problems: */",
        "demo_format": "/* Answer the following: {question}*/\n{query}",
        "demo_suffix": None,
        "demo_sep": "\n\n",
        "q_prefix": "/* Given the following database schema: */",
        "q_evidence": None,
        "q_body": "/* Answer the following: {question}*/\nSELECT ",
        "q_suffix": None,
        "q_sep": "\n\n",
        "section_sep": "\n\n",
        "max_tokens": 4096,
    },
    "template_option_3": {
        "instruction": None,
        "demo_prefix": "/* Some example questions and corresponding SQL queries are provided based on similar problems: */",
        "demo_format": "/* Answer the following: {question}*/\n{query}",
        "demo_suffix": None,
        "demo_sep": "\n\n",
        "q_prefix": "/* Given the following database schema: */",
        "q_evidence": None,
        "q_body": "/* Answer the following: {question}*/\nSELECT ",
        "q_suffix": None,
        "q_sep": "\n\n",
        "section_sep": "\n\n",
        "max_tokens": 4096,
    },
    "template_option_4": {
        "instruction": "### Complete sqlite SQL query only and with no explanation.",
        "demo_prefix": "### Some example pairs of question and corresponding SQL query are provided based on similar problems:",
        "demo_format": "### Answer the following question: {question}\n{query}",
        "demo_suffix": None,
        "demo_sep": "\n\n",
        "q_prefix": "### Given the following database schema:",
        "q_evidence": "### Given the following evidence:\n{evidence}",
        "q_body": "### Answer the following question: {question}",
        "q_suffix": "SELECT ",
        "q_sep": "\n\n",
        "section_sep": "\n\n",
        "max_tokens": 4096,
    },
}

# Flat string templates (option_1..option_3) and their section headers.
FLAT_DEMO_FORMAT = "### Answer the following question: {question}\n{query}"
FLAT_TEMPLATES = {
    "option_1": {
        "head": "### Complete sqlite SQL query only and with no explanation.\n\n",
        "demo_header": "### Some example pairs of question and corresponding SQL query are provided based on similar problems:\n\n",
        "schema_header": "### Given the following database schema:\n",
        "question": "### Answer the following question: {question}",
    },
    "option_2": {
        "head": "/* Complete sqlite SQL query only and with no explanation.*/\n\n",
        "demo_header": "/* Some example pairs of question and corresponding SQL query are provided based on similar problems: */:\n\n",
        "schema_header": "/* Given the following database schema: */:\n",
        "question": "/* Answer the following: {question} */\nSELECT ",
    },
    "option_3": {
        "head": "",
        "demo_header": "/* Some example pairs of question and corresponding SQL query are provided based on similar problems: */:\n\n",
        "schema_header": "/* Given the following database schema: */:\n",
        "question": "/* Answer the following: {question} */\nSELECT ",
    },
}

# Error-correction instruction header lines and rule groups 1-4.
CORRECTION_HEAD = (
    "#### For the given question, use the provided tables, columns, foreign keys, and primary keys "
    "and additional evidence (if there is) to fix the given SQLite SQL QUERY for any issues. If there "
    "are any problems, fix them. If there are no issues, return the SQLite SQL QUERY as is.\n"
)
CORRECTION_HEAD_CUSTOM = (
    "#### For the given question, use the provided tables, columns, foreign keys, and primary keys "
    "to fix the given SQLite SQL QUERY for any issues. If there are any problems, fix them. If there "
    "are no issues, return the SQLite SQL QUERY as is.\n"
)
CORRECTION_RULES_LINE = "#### Use the following instructions for fixing the SQL QUERY:\n"
RULE_GROUPS = {
    1: [
        "Use the db_name values that are explicitly mentioned in the question.",
        "Pay attention to the columns that are used for the JOIN by using the Foreign_keys.",
        "Use DESC and DISTINCT when needed.",
        "Pay attention to the columns that are used for the GROUP BY statement.",
        "Pay attention to the columns that are used for the SELECT statement.",
        "Only change the GROUP BY clause when necessary (Avoid redundant columns in GROUP BY).",
        "Use GROUP BY on one column only.",
    ],
    2: [
        "When the question only asks for a certain field, please don't include the COUNT(*) in the SELECT statement, but instead use it in the ORDER BY clause to sort the results based on the count of that field.",
        "Please don't use \"IN\", \"OR\", \"LEFT JOIN\" as it might cause extra results, use \"INTERSECT\" or \"EXCEPT\" instead, and remember to use \"DISTINCT\" or \"LIMIT\" when necessary.",
    ],
    3: [
        "Don't make error that write queries with multiple join operations as one with nested subqueries with IN keyword, please use join to get correct results in such cases.",
        "Please think when to use conjunction, sometimes you may need to use conjunction to get correct results.",
    ],
    4: [
        "When the question only asks for a certain field, please don't include the COUNT(*) in the SELECT statement, but instead use it in the ORDER BY clause to sort the results based on the count of that field.",
        "Please don't use \"IN\", \"LEFT JOIN\" as it might cause extra results, use \"INTERSECT\" or \"EXCEPT\" instead, and remember to use \"DISTINCT\" or \"LIMIT\" when necessary.",
    ],
}

# Keyword replacement map of the graph augmenter.
KEYWORD_REPLACEMENTS = {
    "EQ": ["NEQ", "GT", "LT"],
    "NEQ": ["EQ", "GT", "LT"],
    "GT": ["LT", "GTE", "LTE"],
    "GTE": ["GT", "LTE", "LT"],
    "LT": ["GT", "LTE", "GTE"],
    "LTE": ["LT", "GTE", "GT"],
    "AND": ["OR"],
    "OR": ["AND"],
    "SUB": ["ADD", "MUL", "DIV"],
    "ADD": ["SUB", "MUL", "DIV"],
    "DIV": ["MUL", "ADD", "SUB"],
    "MUL": ["DIV", "ADD", "SUB"],
    "COUNT": ["SUM", "AVG", "MIN", "MAX"],
    "SUM": ["COUNT", "AVG", "MIN", "MAX"],
    "AVG": ["COUNT", "SUM", "MIN", "MAX"],
    "MIN": ["COUNT", "SUM", "AVG", "MAX"],
    "MAX": ["COUNT", "SUM", "AVG", "MIN"],
}

# Keywords never masked by feature masking.
CRITICAL_KEYWORDS = ("SELECT", "JOIN", "WHERE", "GROUP", "ORDER")
MASK_TOKEN = "<mask>"

# Literal pattern of the rule-based repair (quoted by ' or ", optionally escaped).
LITERAL_RE = r"""(?:(?:\\)?["'])(.*?)(?:(?:\\)?["'])"""
