"""Patterns, word lists and tables that results depend on, in natural order.

Patterns are in ECMAScript spelling; `dialect.java` and `dialect.re2` spell them for the engines.
"""

# ---- fixed values: escapes and links ---------------------------------------------------------------
WEB_AUTOLINK = r"\\?<((?:https?|ftp):\/\/[^\s<>]+)\\?>"
MAIL_AUTOLINK = r"\\?<mailto:([^\s<>]+)\\?>"
AUTOLINK_LINE = r"^\s*\\?<(?:https?|ftp|mailto):"
ESCAPED_ELLIPSIS = r"\\\.\.\."
ESCAPED_ANY = r"\\(.)"
ESCAPED_PUNCTUATION = r"""\\([<>"'[\](){}|$~^@+!.,:;=?/&%-])"""
BOLD_SPACE_END = r"\*\*(\S(?:[^*]*?\S)?)(\s+)\*\*"
BOLD_SPACE_START = r"\*\*(\s+)([^*]*?\S)\*\*"
WHOLE_LINE_BOLD = r"^(\s*)\*\*([\s\S]+?)\*\*(\s*)$"

# ---- fixed values: structure -----------------------------------------------------------------------
HEADING = r"^(#{1,6})\s+(.*?)(?:\s*\{[^}]*\})?\s*$"
LIST = r"^(\s*)([-*+]|\d+[.)])\s+"
QUOTE = r"^\s*>\s?"
IMAGE = r"!\[[^\]]*\]\(([^)\s]*media\/[^)\s]+)\)(?:\{[^}]*\})?"
FENCE_BARE = r"^```\s*$"
FENCE_HTML = r"^```\{=html\}\s*$"

# ---- fixed values: code and prose ------------------------------------------------------------------
KEYWORD_START = (
    r"^\s*(const|let|var|function|class|import|export|return|if|else|for|while|switch|case|"
    r"break|continue|try|catch|finally|throw|new|typeof|instanceof|delete|async|await|"
    r"interface|type|enum|namespace|declare|abstract|implements|extends|super|static|yield|"
    r"do|default|public|private|protected|readonly|constructor|get|set|module|require|from)\b"
)
SHELL_START = (
    r"^\s*(npm|npx|yarn|pnpm|pnpx|git|node|tsc|deno|bun|cd|rm|ls|mkdir|touch|cp|mv|curl|code|parcel|webpack|vite|"
    r"http-server|live-server|serve|sudo|chmod|echo|export)\s+\S"
)
API_TOKENS = (
    r"\b(console\.(log|error|warn|info|table|dir|trace)|"
    r"document\.(getElementById|querySelector|querySelectorAll|createElement|addEventListener|body|head)|"
    r"window\.[a-z]|navigator\.[a-z]|localStorage\.|sessionStorage\.|JSON\.(parse|stringify)|"
    r"Object\.(keys|values|assign|entries|create|freeze|defineProperty|getPrototypeOf)|"
    r"Array\.(from|isArray|prototype)|Math\.[a-z]|Promise\.(all|resolve|reject|race)|"
    r"module\.exports|exports\.|require\(|addEventListener\(|\.prototype\.|this\.[a-zA-Z_$])"
)
CONNECTORS = (
    r"\b(que|para|cuando|porque|entonces|donde|como|pero|sino|desde|hasta|aunque|mientras|"
    r"según|sobre|además|también|siempre|nunca|cada|entre|durante|mediante|"
    r"el|la|los|las|un|una|unos|unas|del|al|de|en|con|por|sin|su|sus|lo|"
    r"es|son|está|están|ser|estar|hay|tiene|tienen|se|nos|le|les|"
    r"podemos|debemos|tenemos|permite|permiten|sirve|significa|decir|usamos|"
    r"esto|esta|este|estos|estas|eso|ese|esa|nuestro|nuestra|nuestros|todo|toda)\b"
)
HARD_SYNTAX = (
    r"=>|\bfunction\s*\(|\)\s*\{|[;{}]\s*$|"
    r"""^\s*["'`][\w$.-]+["'`]\s*:|^\s*[\w$-]+\s*:\s*["'`{[]|"""
    r"^\s*<[a-zA-Z/!]|^\s*\w+\s*=\s*\w"
)
ACCENTED = r"[áéíóúñ¿¡ÁÉÍÓÚÑ]"
PURE_TEXT = r"^[\p{L}\p{M}\d\s,'¿?¡!-]+[.:]?$"
SPANISH_WORD = (
    r"[áéíóúñÁÉÍÓÚÑ]|\b(el|la|los|las|un|una|unos|unas|de|del|al|en|con|por|sin|para|que|si|no|y|o|u|e|"
    r"otra|otro|otras|otros|más|menos|como|cuando|entre|sobre|desde|hasta|"
    r"es|son|está|están|hay|ser|estar|nuestro|nuestra|nuestros|su|sus|lo|se|"
    r"cambio|ejemplo|caso|casos|forma|manera|solución|explicación|nota|resumen|"
    r"tenemos|vemos|usamos|ejecutamos|podemos|debemos|hacemos|"
    r"solo|sólo|también|además|pero|aunque|entonces|luego|ahora|"
    r"a|esto|esta|este|estos|estas|eso|ese|esa|dos|tres|todo|toda|todos|todas)\b"
)
FILE_PATH_LABEL = (
    r"^(?:\.{0,2}/)?[\w.@-]+(?:/[\w.@-]+)+/?$|"
    r"^(?:\./)?[\w-]+\.(?:json|jsonc|ts|tsx|js|jsx|mjs|cjs|css|scss|sass|less|"
    r"html|htm|vue|svelte|md|yml|yaml|txt|xml|svg|lock|env|sh|toml|ini)$"
)
FILE_TOKEN = (
    r"\b[\w-]+\.(?:json|jsonc|ts|tsx|js|jsx|mjs|cjs|css|scss|sass|less|html|htm|vue|"
    r"svelte|md|yml|yaml|txt|xml|svg|lock|env|sh|toml|ini|png|jpe?g|gif|mp4)\b"
    r"|\b[\w-]+(?:/[\w.-]+)+\b"
)
SPANISH_FUNCTION_WORD = (
    r"\b(el|la|los|las|un|una|unos|unas|de|del|al|en|con|sin|por|para|que|si|y|o|u|e|entre|sobre|desde|hasta|como|"
    r"cuando|pero|aunque|es|son|está|están|hay|se|su|sus|lo|no|más|otra|otro|también|además|nuestro|nuestra)\b"
)
URL_SCHEME = r"^(?:https?|ftp|mailto):"
BARE_URL = r"^\s*(?:https?|ftp):\/\/\S+\s*$"
ANCHOR_LINK = r"\]\(#"
ONLY_LINKS = r"^(\s*\[[^\]]*\]\([^)]*\)\s*)+$"
COMMENT_START = r"^\s*(\/\/|\/\*|\*\/)"
NBSP_INDENT = r"^[\u00a0 ]*\u00a0[\u00a0 ]*\S"
NBSP_START = r"^[\u00a0 ]*\u00a0"
HTML_TAG_START = r"^\s*<\/?[a-zA-Z][\w:-]*(\s[^<>]*)?\/?>"
DOCTYPE_START = r"^\s*<!(DOCTYPE|--)"
ONLY_CLOSERS = r"^\s*[}\])]+[;,)]?\s*$"
LONE_OPENER = r"^\s*[{[]\s*$"
CODE_END = r"[{};]\s*$"
BOLD_LINE = r"^\*\*([\s\S]+?)\*\*[.:]?$"
STATEMENT_END = r"[;{}]\s*$"
SENTENCE_COLON_END = r"[.:]\s*$"
SENTENCE_END = r"[.!?]\s*$"
FIRST_CALL = r"[\w$]\s*\(([^()]*)\)"
CALL_ARGUMENT = r"""["'`;=]|=>"""
DOTTED_NAME = r"[A-Za-z_$][\w$]*\.[A-Za-z_$]"
NUMBER = r"^-?\d+(?:\.\d+)?$"
NOT_A_GLOSS = r"""["'`;=.]|=>|\d"""
GLOSS = r"^[\p{L}][\p{L}\s-]*$"
ARROW = r"=>"
KEY_VALUE = r"""^\s*["'`]?[\w$@/-]+["'`]?\s*:\s*.+[,;]?\s*$"""
METHOD_START = r"^\s*\.\w+\("
CALL_AT_END = r"\w+\s*\(([^()]*)\)\s*[;{]?\s*$"
OPERATORS = r"[=!<>]==?|\w\+\+|\+\+\w|\w--|--\w|&&|\|\||\?\?"
MEMBER = r"[a-zA-Z_$]\w*\.[a-zA-Z_$]\w*"
BRACKET = r"[()[\]{}]"
#: What takes syntax out of a sentence, in the order it goes.
RESIDUE = (
    r"`[^`]*`",
    r"""'[^']*'|"[^"]*\"""",
    r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+",
    r"[A-Za-z_$][\w$]*\s*\([^()]*\)",
    r"\{[^{}]*\}",
    r"<\/?[A-Za-z][^<>]*>",
    r"[*_=;:{}()[\]<>+/%|&!?~^@#\\-]",
    r"\s+",
)

# ---- what a text must have for a pattern to match, quickly seen; for Java only ----------------------
#: For all of RESIDUE but its last two. Each of these starts with one set of characters, so that other characters are passed over at once.
RESIDUE_HINT = r"""[`'"({<.](?:(?<!\.)|(?<=[\w$]\.)(?=[A-Za-z_$]))"""
HARD_SYNTAX_HINT = r"[=({;}:<]"
API_TOKENS_HINT = r"[.(](?:(?=[A-Za-z_$(])|(?<=Storage\.|exports\.|require\(|addEventListener\())"
CALL_END = r"\)\s*[;{]?\s*$"
OPERATORS_HINT = r"[=+&|?-]"
MEMBER_HINT = r"\.(?=[a-zA-Z_$])(?<=[\w$]\.)"
FILE_TOKEN_HINT = r"[./](?:(?<=/)|(?<=[\w-]\.)(?=[^ ]))"
#: What keeps a text from being a label: characters that neither PURE_TEXT nor a file name has, or two full stops that end words.
NO_LABEL = r"""["(){}[\];<>=&|#$%@^~+`\\.](?:(?<!\.)|(?=\s)[\s\S]*?\.\s)"""

# ---- fixed values: modules, rendering and blocks ---------------------------------------------------
INDEX_TITLE = r"^(contenido|índice|indice|tabla de contenido)"
DANGLING = r"[^=!<>+\-*/%&|^]=\s*$"
DOCUMENT_END = r"^\s*<\/html>\s*$"
RENDERED_IMAGE = r"!\[\]\((image[^)]+)\)"
BLOCK_HEADING = r"^(#{1,3})\s+(.*)$"
BLOCK_BULLET = r"^(\s*)[-*+]\s+(.*)$"
BLOCK_NUMBER = r"^(\s*)\d+\.\s+(.*)$"
BLOCK_IMAGE = r"^!\[\]\((image[^)]+)\)\s*$"

# ---- fixed values: languages -----------------------------------------------------------------------
TYPE_NAME = r"(?:string|number|boolean|any|void|never|unknown|object|symbol|bigint|Array<|Promise<|[A-Z]\w*)"
LANG_TAG_LINE = r"^<\/?[a-zA-Z!]"
LANG_DOCTYPE = r"^<!DOCTYPE\s+html"
LANG_SHELL_FIRST = r"^\s*(npm|npx|yarn|pnpm|git|tsc|node|cd|rm|mkdir|sudo|curl)\b"
LANG_SHELL_LINE = r"^(npm|npx|yarn|pnpm|git|tsc|node|cd|rm|ls|mkdir|touch|cp|mv|curl|code|sudo|#|\$)"
LANG_JSON_KEY = r'"[^"]+"\s*:'
LANG_JSON_NOT = r"\b(function|const|let|var|=>|return)\b"
LANG_CSS_LINE = r"^[.#]?[\w-]+\s*\{$|^[\w-]+\s*:\s*[^;]+;$"
LANG_CSS_NOT = r"\b(function|const|let|var|=>)\b"
LANG_TS_STRONG = (
    r"\b(interface|enum|namespace|declare|implements)\s+[A-Za-z_$]",
    r"\b(readonly|public|private|protected)\s+[A-Za-z_$]",
    r"\bas\s+[A-Z]\w*",
    r"\b(?:let|const|var)\s+[\w$]+\s*:\s*" + TYPE_NAME,
    r"\([^)]*\b[\w$]+\s*:\s*" + TYPE_NAME,
)
LANG_TS_RETURN = r"\)\s*:\s*" + TYPE_NAME + r"[\w<>\[\]|]*\s*(?:\{|=>|;|$)"
SAFE_LANGUAGES = (
    "abap", "arduino", "bash", "basic", "c", "clojure", "coffeescript", "c++", "c#",
    "css", "dart", "diff", "docker", "elixir", "elm", "erlang", "flow", "fortran",
    "f#", "gherkin", "glsl", "go", "graphql", "groovy", "haskell", "html", "java",
    "javascript", "json", "julia", "kotlin", "latex", "less", "lisp", "livescript",
    "lua", "makefile", "markdown", "markup", "matlab", "mermaid", "nix",
    "objective-c", "ocaml", "pascal", "perl", "php", "plain text", "powershell",
    "prolog", "protobuf", "python", "r", "reason", "ruby", "rust", "sass", "scala",
    "scheme", "scss", "shell", "sql", "swift", "typescript", "vb.net", "verilog",
    "vhdl", "visual basic", "webassembly", "xml", "yaml",
)
PLAIN_TEXT = "plain text"

# ---- fixed values: limits and remote names ---------------------------------------------------------
MAX_TEXT = 2000
MAX_BLOCKS = 100
MAX_UPLOAD = 20 * 1024 * 1024
MIN_INTERVAL_MS = 340
MAX_RETRIES = 5
MIME = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".svg": "image/svg+xml",
    ".bmp": "image/bmp",
    ".tiff": "image/tiff",
    ".emf": "image/emf",
}
DEFAULT_MIME = "application/octet-stream"
GENERIC_NAMES = ("clase", "clases")
DEFAULT_SLUG = "modulo"
DEFAULT_STATUS = "Terminado"
NO_TITLE = "(sin título)"
ICON = "🖼️"
ICON_COLOR = "gray_background"
COURSE_PROPERTIES = ("Título", "Área", "Plataforma", "Estado", "Módulos", "Archivo origen", "Última sincronización")
