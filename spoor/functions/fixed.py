"""What texts are matched against. Results depend on them to the letter.

Patterns are in the dialect that Java and Python share; the scanner's ignore case.
"""

# --- Fixed values: indicator categories, in the order of reports, with their headings.
CATEGORIES = {
    "protocols_full": "Protocol URLs",
    "urls": "URLs",
    "domains": "Domains",
    "files": "Files",
    "main_patterns": "Main Functions/Variables",
    "ssh_patterns": "SSH Client References",
    "openssh_full": "OpenSSH Full References",
    "operational_files": "Operational Files",
    "dependency_paths": "Dependency/Library Paths",
}

# --- Fixed values: patterns of the categories that are found as whole matches.
INDICATORS = {
    "protocols_full": r"\b(?:https?|ftp|socks[45]?|ssh)://[a-zA-Z0-9._-]+(?:\.[a-zA-Z]{2,})?(?::[0-9]+)?(?:/[^\s\"'<>]*)?",
    "urls": r"\b(?:https?|ftp|socks[45]?)://[^\s\"'<>]{8,}",
    "domains": r"\b[a-zA-Z0-9.-]+\.(?:tk|ml|ga|cf|top|click|download|security|update|onion|com|net|org|io|dev|ai|xyz)\b",
    "files": r"\b[a-zA-Z0-9_.-]+\.(?:exe|dll|scr|bat|cmd|pif|com|vbs|js|jar|zip|rar|7z|php|ps1|sh)\b",
    "main_patterns": r"\b(?:main\.[a-zA-Z0-9_]+|main_[a-zA-Z0-9_]+|_main[a-zA-Z0-9_]*)\b",
    "ssh_patterns": r"\b[a-zA-Z0-9_]*SSH(?:Client|Connection|Session)[a-zA-Z0-9_]*\b",
    "openssh_full": r"\b[a-zA-Z0-9._-]+@openssh\.com\b",
}

# --- Fixed values: hash headers of a listing (group 1), lines that are left out, quoted strings (group 1).
HASHES = {
    "sha256": r";\s*Input SHA256\s*:\s*([A-Fa-f0-9]{64})",
    "md5": r";\s*Input MD5\s*:\s*([A-Fa-f0-9]{32})",
    "crc32": r";\s*Input CRC32\s*:\s*([A-Fa-f0-9]{8})",
}
BOILERPLATE = (
    r";\s*(?:\+\-+\+|\|\s*(?:This file was generated by|Copyright|License info).*|Input (?:SHA256|MD5|CRC32)\s*:"
    r"|File Name\s*:|(?:Compiler|Format|Imagebase)\s*:)"
)
STRINGS = r"(?:db\s+)?[\"']([^\"']{5,200})[\"']"
BAD_IN_STRINGS = ("...", "%s", "%a", "%d", "%c")

# --- Fixed values: Windows paths (group 1). The last one's class excludes backslash and the letter s, not white space.
PATHS = (
    r"[\"']([A-Za-z]:[/\\][^\"']*[/\\][^\"/'\\]*(?:\.[a-zA-Z0-9]{2,4})?)[\"']",
    r"\b([A-Za-z]:[/\\][a-zA-Z0-9_\.\-/\\]+\.[a-zA-Z0-9]{2,4})\b",
    r"[\"']([/\\][/\\][a-zA-Z0-9.-]+[/\\][^\"'\\]+[/\\][^\"']*)[\"']",
)
REGISTRY = r"[\"']?(HKEY_[A-Z_]+[/\\][^\"'\\s]+)[\"']?"
#: What the class seems meant to be: up to white space or a quote.
REGISTRY_MEANT = r"[\"']?(HKEY_[A-Z_]+[/\\][^\"'\s]+)[\"']?"
BAD_IN_PATHS = ("%s", "%d", "%c", "%x", "%y", ":%", "@%")
GO_MODULE = r"[/\\]pkg[/\\]mod[/\\].*(?:@v\d+\.\d+\.\d+|\.org[/\\]x[/\\]|@[^/\\]*[/\\])"
SUSPICIOUS_PATH = (
    r"(?:[/\\](?:work|project|src|source|code|build|bin|cmd|command)[/\\]"
    r"|[/\\](?:main|app|tool|util|client|server)\.[a-z]+$|^[A-Za-z]:[/\\](?:work|project|src|code|build|bin)[/\\])"
)
DEPENDENCY = r"(?:go[/\\]pkg[/\\]|[/\\]program files(?:\s\(x86\))?[/\\])"

# --- Fixed values: validity of indicators.
BAD_ENDINGS = ("...", '@"', "@'", '"', "'")
FORMATS = ("%s", "%a", "%d")
SCHEMES = ("http://", "https://", "ftp://", "socks4://", "socks5://", "ssh://")

# --- Fixed values: the terms that are denied by default, as in a list file with its heading.
DENYLIST_FILE = """=== BLACKLIST URLS ===
hex-rays.com
godebug.update
golang.org
libssh.org
openssh.com
"""

# --- Fixed values: headers of functions, in the order in which they are tried (group 1 is the name).
HEADERS = (
    r"^\s*(?:__int64|int|void|char|unsigned|signed|static|extern|inline)\s+(?:\w+\s+)*(\w+(?:\s+\w+)*)\s*\(",
    r"^\s*(?:__int64|int|void|char|unsigned|signed|static|extern|inline).*?(\w+(?:\s+\w+)*)\s*\([^)]*\)\s*$",
    r"^\s*(?:__int64|int|void|char|unsigned|signed|static|extern|inline)\s+(\w+(?:\s+\w+)*)\s*\([^)]*\)\s*(?:\{|\s*$)",
    r"^\s*(\w+(?:\s+\w+)*)\s*\([^)]*\)\s*$",
    r"^\s*(?:volatile\s+)?(?:\w+\s+\*+\s*)+(\w+(?:\s+\w+)*)\s*\(",
    r"^\s*\*+\s*(?:volatile\s+)?(?:__int\d*\s+)?\*+\s*(?:\w+\s+)*?(\w+(?:\s+\w+)*)\s*\(",
)
RETURN_TYPES = ("bool", "int", "void", "char", "__int64", "unsigned", "signed")
LOOKBACK_WORDS = ("void", "int", "char", "__int64", "unsigned", "volatile")
CALLS = (r"(\w+)\s*\(", r"return\s+(\w+)\s*\(")
#: A name followed or preceded by these near a call is a variable.
VARIABLE_MARKS = ("{} =", "{}++", "{}--", "{}[", "{}.", "{}->", "&{}", "*{}")

# --- Fixed values: names that are classified by default, in a library file with two sections.
LIBRARY_FILE = """=== FUNCTIONS ===
# add actual function names here, one per line
runtime__*
main_*

=== NON-FUNCTIONS ===
# add non-function names here, one per line
# language keywords
if
else if
while
for
switch
int
return
char
void
static
extern
memset
qmemcpy
reflect_*
a*
v*
LABEL_*
qword_*
BYTE*
SBYTE*
*WORD
LOWORD
JUMPOUT
LOBYTE
LODWORD
HIBYTE
HIDWORD
_BitScanForward*
_InterlockedAnd*
_InterlockedOr*
__int*
_mm_*
os_*
sys_*
fmt_*
type_*
time_*
_Interlocked*
__PAIR64__
__SPAIR64__
__int64
__writefsqword
__readfsqword
_InterlockedExchange
__rdtsc
sys_arch_prctl
internal_bytealg_IndexByteString
__CFADD__
__OFADD__
__OFSUB__
__PAIR128__
__ROL4__
__ROR4__
__ROR8__
__debugbreak
_byteswap_uint64
_byteswap_ulong
# other
memory
called
indexbytebody
tracealloc
callRet
d
edx
"""
LIBRARY_TEMPLATE = (
    "=== FUNCTIONS ===\n# add actual function names here, one per line\n\n"
    "=== NON-FUNCTIONS ===\n# add non-function names here, one per line\n\n"
)

# --- Fixed values: headings of the files that are written.
CLASSIFICATION_HEAD = (
    "=== NEW FUNCTIONS TO CLASSIFY ===\n(add these to pseudo_C_analyzer_lib.txt under FUNCTIONS or NON-FUNCTIONS)\n"
)
CLASSIFIED_ALL = "all functions already classified in pseudo_C_analyzer_lib.txt\n"

# --- Fixed values: what is told of files, and when there is nothing to report.
PROGRESS_EVERY = 25
PROGRESS = "Progress: {done}/{total} files processed"
NOTHING_FOUND = "no IoCs found in the scanned files"
