"""Fixed values.

These texts, numbers and lists must be exactly so for the results to be right;
they are inputs and limits, stated as they are.
"""

# Feed requests: default number of stories and its allowed range.
FEED_DEFAULT_N, FEED_MIN_N, FEED_MAX_N = 10, 1, 500

# Question requests: default number of queries and its allowed range.
QUESTION_DEFAULT_N, QUESTION_MIN_N, QUESTION_MAX_N = 5, 1, 10

# Candidate ranking returns this many queries unless told otherwise.
TOP_K = 3

# A line is kept when it is longer than this many characters.
LONG_LINE_CHARS = 200

# A story's text is cut to this many characters before its title is added.
MAX_TEXT_CHARS = 200_000

# Runs per model, and sampled variants per question.
ITERATIONS = 10
VARIANTS = 4

# Marker written in place of the queries of an unreadable response.
PARSE_FAILURE_PREFIX = "Failed to parse response: "

# Element content that is not page text.
SILENT_ELEMENTS = ["script", "style", "template", "rt", "rp"]

# Characters that stripping removes at both ends: all Unicode white space.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

MODELS = [
    {"name": "phi-2", "id": "microsoft/phi-2"},
    {"name": "Phi-3-mini-4k-instruct", "id": "microsoft/phi-3-mini-4k-instruct"},
    {"name": "Phi-3-mini-128k-instruct", "id": "microsoft/phi-3-mini-128k-instruct"},
    {"name": "Phi-4-mini-instruct", "id": "microsoft/Phi-4-mini-instruct"},
    {"name": "Llama3.2-3B-Instruct", "id": "meta-llama/Llama-3.2-3B-Instruct"},
    {"name": "Gemma3-1B-Instruct", "id": "google/gemma-3-1b-it"},
    {"name": "Gemma3-4B-Instruct", "id": "google/gemma-3-4b-it"},
    {"name": "Qwen2.5-7B-Instruct", "id": "Qwen/Qwen2.5-7B-Instruct"},
    {"name": "Nemotron-Mini-4B-Instruct", "id": "nvidia/Nemotron-Mini-4B-Instruct"},
]

# Prompt of the model comparison (its inner lines are indented).
PROMPT_TEMPLATE = """You are a search query reformulator.
    Respond with a JSON object with a single key "queries" containing a list of search queries that answer the input.

    Input: {query}
    Output:"""

# Prompt of the single-model experiment.
PLAIN_PROMPT_TEMPLATE = """You are a search query reformulator.
Respond with a JSON object with key "queries" containing a list of search queries that answer the input.

Input: {query}
Output:"""

# Few-shot prompt: instructions and three worked examples, then the question.
FEWSHOT_TEMPLATE = """You are a search query reformulator.
Given a user question, respond ONLY with a JSON object in the following format:

{
  "queries": [
    "search query 1",
    "search query 2"
  ]
}

Do not include any text before or after the JSON.
Do not explain.
Do not answer the question.
Only provide search queries.

Examples:

User: Who lived longer, Nikola Tesla or Milutin Milankovic?
{
  "queries": [
    "Nikola Tesla lifespan",
    "Milutin Milankovic lifespan"
  ]
}

User: In what year was the winner of the 44th edition of the Miss World competition born?
{
  "queries": [
    "44th Miss World competition winner birth year"
  ]
}

User: what are some ways to do fast query reformulation
{
  "queries": [
    "fast query reformulation techniques",
    "query reformulation algorithms",
    "query expansion methods",
    "query rewriting approaches",
    "query refinement strategies"
  ]
}

User: {query}
"""
