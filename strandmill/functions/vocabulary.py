"""Word lists and prompt texts of note building."""

from __future__ import annotations

#: Words that are no keywords.
STOPWORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used
to of in for on with at by from as into through during before after above below between out off over under again further then once
here there when where why how all both each few more most other some such no nor not only own same so than too very just because but
and or if while about up it its i me my you your he she they we this that these those what which who whom says said speaker
""".split()
#: Words that are no keywords by themselves.
GENERIC = """
activity anything chat conversation event events experience experiences farewell goodbye happened life meeting people person session
situation something stuff talk thing things time topic topics work
""".split()
#: Fillers.
FILLERS = "awesome cool definitely glad great hey image let like looks ok okay photo really sounds thank thanks wow yeah yep".split()
#: Times.
TIMES = "today tomorrow yesterday tonight morning afternoon evening night week weekend month year daily".split()

#: No keyword holds one of these; of its other words, those in FILTERED don't count.
BARRED = frozenset(GENERIC) | frozenset(TIMES) | frozenset(FILLERS)
FILTERED = BARRED | frozenset(STOPWORDS)

#: Prompts.
ANALYSE = """Analyze the following content and provide:
1. KEYWORDS: The most important keywords (nouns, verbs, key concepts). Order from most to least important. At least three keywords. Do not include speaker names or time references.
2. CONTEXT: One sentence summarizing the main topic, key points, and purpose.
3. TAGS: Broad categories/themes for classification (domain, format, type). At least three tags.

Respond using EXACTLY this format (one section per header):

KEYWORDS: keyword1, keyword2, keyword3, ...
CONTEXT: A single sentence summarizing the content.
TAGS: tag1, tag2, tag3, ...

Content for analysis:
{content}"""
DECIDE = """You are an AI memory evolution agent. Analyze the new memory note and its nearest neighbors to decide if evolution is needed.

New memory:
- Context: {context}
- Content: {content}
- Keywords: {keywords}

Nearest neighbor memories:
{neighbours}

Based on the relationships between the new memory and its neighbors, decide:
- NO_EVOLUTION: The memory stands alone, no changes needed.
- STRENGTHEN: The new memory should be linked to some neighbors and its tags updated.
- UPDATE_NEIGHBOR: The neighbors' context/tags should be updated based on new understanding.
- STRENGTHEN_AND_UPDATE: Both strengthen and update neighbors.

Respond using EXACTLY this format:
DECISION: <one of NO_EVOLUTION, STRENGTHEN, UPDATE_NEIGHBOR, STRENGTHEN_AND_UPDATE>
REASON: <brief explanation>"""
STRENGTHEN = """Given the new memory and its neighbors, provide updated connections and tags.

New memory:
- Content: {content}
- Keywords: {keywords}

Neighbor memories:
{neighbours}

Which neighbor indices should the new memory connect to? What tags best describe this memory?

Respond using EXACTLY this format:
CONNECTIONS: 0, 2, 3
TAGS: tag1, tag2, tag3, ..."""
UPDATE = """Given the new memory and its neighbor memories, update each neighbor's context and tags based on a holistic understanding of all these memories together.

New memory:
- Content: {content}
- Context: {context}

Neighbor memories:
{neighbours}

For each neighbor (indexed 0 to {last}), provide updated context and tags. If no change is needed, repeat the original values.

Respond using EXACTLY this format (one block per neighbor):

NEIGHBOR 0:
CONTEXT: updated context sentence
TAGS: tag1, tag2, tag3

NEIGHBOR 1:
CONTEXT: updated context sentence
TAGS: tag1, tag2, tag3

(continue for all {count} neighbors)"""
KEYWORDS_ONLY = """List exactly 5 keywords that capture the main concepts of the following text. Output only the keywords, comma-separated, nothing else.

Text: {content}"""
