"""What the rules say. Users and suppressions know these texts; {} stands for a name or number."""

LIST_COMP = "Consider a list comprehension instead of appending to '{}' in a loop."
F_STRING = "Use an f-string instead of manual string concatenation."
WITH_OPEN = "Use 'with open(...)' instead of calling open() without closing."
ENUMERATE = "Use 'enumerate({})' instead of 'range(len({}))' indexing."
ZIP = "Use zip({}) to iterate these sequences in parallel."
DICT_GET = "Use dict.get() instead of 'if key in dict' then subscript."
IDENTITY = "Use 'is None'/'is not None' instead of '== None'/'!= None'."
STR_JOIN = "Build a list of parts and use str.join instead of concatenating '{}' in a loop."
DEFAULTDICT = "Use collections.defaultdict(list) instead of manual init-then-append aggregation."
ANY_ALL = "Use {}() instead of a manual loop to test a condition."
NEXT = "Use next(gen, default) instead of a manual first-item loop."
PATHLIB = "Use pathlib.Path instead of os.path.{}(...) — e.g. path.{}."
DATACLASS = "Class '{}' holds only attributes — consider dataclasses.dataclass."
KEY = "Use key= with sorted()/max()/min() instead of a manual comparison lambda."
REMOVE = "Use str.removeprefix()/str.removesuffix() instead of manual slicing (3.9+)."
NESTED_DEF = "Function '{}' is defined inside another function. Consider hoisting it to module or method level."
TOP_IMPORT = "Import '{}' is inside a function/method — imports are usually clearer at the top of the file."
LARGE_CLASS = "Class '{}' spans {} lines — consider splitting it by responsibility."
DUP_BLOCK = "Block at line {} repeats code at line {}. Consider extracting a helper."
DUP_METHOD = "Method '{}.{}' duplicates '{}.{}'. Consider a shared base class or mixin."
UNUSED = "Instance attribute 'self.{}' is assigned in __init__ but never read in class '{}'. Remove it or use it."
NESTING = "Code is nested more than {} levels deep ({} levels). Consider extracting a method."
