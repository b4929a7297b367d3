"""Grammars of the analysed languages (problem 1), in the notation of ``machine``."""

from __future__ import annotations

from graphloom.llm.machine import Machine

# --- fixed values: reserved words of the languages, where a grammar below needs them as names --------------
JS_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split()
JS_CONTEXT = "as assert async await from get let of set static yield".split()
TS_CONTEXT = "abstract accessor asserts declare enum global implements infer interface is keyof module namespace out override private protected public readonly require satisfies type unique".split()
PY_SOFT = "match case type".split()
RUBY_RESERVED = "alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split()
# --- end of fixed values ------------------------------------------------------------------------------------


def _any(words) -> str:
    return " | ".join(f"'{w}'" for w in words)


_SCRIPT = """
file = item*
item = stmt | import | export | @ITEM
eos = ';' | ASI
block = stmt*
stmt = B:block | ';' | var eos | 'if' P:expr stmt ('else' stmt)? | 'for' 'await'? P:forhead stmt | 'while' P:expr stmt
  | 'do' stmt 'while' P:expr eos? | 'return' expr? eos | 'break' id? eos | 'continue' id? eos | 'throw' expr eos
  | 'try' B:block ('catch' (P:catchp)? B:block ('finally' B:block)? | 'finally' B:block) | 'switch' P:expr B:cases | 'with' P:expr stmt
  | 'debugger' eos | id ':' stmt | fdecl | deco* classdecl | sexpr eos | @STMT
catchp = target tann
cases = ('case' expr ':' stmt* | 'default' ':' stmt*)*
var = ('var' | 'let') decl (',' decl)* | 'const' cdecl (',' cdecl)*
decl = id @BANG? tann ('=' assign)? | pattern tann '=' assign
cdecl = target tann '=' assign @CDECL
forhead = (var | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') target ('of' assign | 'in' expr) | 'var' id '=' assign 'in' expr | lhs ('of' assign | 'in' expr)
target = id | pattern
pattern = Q:arraypattern | B:objectpattern
arraypattern = ','* (element (','+ element)*)? ','*
element = '...' target | target ('=' assign)?
objectpattern = (prop_ (',' prop_)* ','?)?
prop_ = '...' target | id ('=' assign)? | propname ':' target ('=' assign)?
fdecl = 'async'? 'function' '*'? id typarams P:params rettype @BODY
func = 'async'? 'function' '*'? id? typarams P:params rettype @BODY
params = (param (',' param)* ','?)?
param = deco* @PARAMMODS ('...' target tann | target @OPT tann ('=' assign)?) @THIS
classdecl = @ABSTRACT 'class' id typarams ('extends' lhs @TARGS)? @IMPLEMENTS B:classbody
class = @ABSTRACT 'class' id? typarams ('extends' lhs @TARGS)? @IMPLEMENTS B:classbody
classbody = (member | ';')*
member = deco* (mods method | mods field eos | 'static' B:block)
mods = (@MODS)*
method = ('async' | 'get' | 'set' | '*')* propname @OPT typarams P:params rettype @BODY
field = propname (@OPT | @BANG) tann ('=' assign)? @INDEXFIELD
deco = '@' (id ('.' name)* (P:args)? | P:expr)
expr = assign (',' assign)*
assign = unary (BINARY unary @ASTYPE)* ('?' assign ':' assign)? | unary @ASTYPE1
sexpr = sassign (',' assign)*
sassign = sunary (BINARY unary @ASTYPE)* ('?' assign ':' assign)? | sunary @ASTYPE1
BINARY = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '**=' | '<<=' | '??=' | '&&=' | '||=' | '??' | '&&' | '||' | '|' | '^' | '&'
  | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' '>'? '>='? | '>' '>'? '>=' | '+' | '-' | '*' | '/' | '%' | '**' | 'in' | 'instanceof'
PREFIX = '+' | '-' | '!' | '~' | '++' | '--' | 'delete' | 'void' | 'typeof' | 'await' | 'new'
unary = PREFIX unary | 'yield' ('*'? assign)? | arrow | lhs ('++' | '--')? @TYPEASSERT
sunary = PREFIX unary | 'yield' ('*'? assign)? | arrow | slhs ('++' | '--')? @TYPEASSERT
arrow = 'async'? (id | typarams P:params rettype) '=>' (B:block | assign)
lhs = primary suffix*
slhs = sprimary suffix*
suffix = ('.' | '?.') '#'? name | '?.' (P:args | Q:expr) | Q:expr | P:args | template @SUFFIX
primary = sprimary | B:object | func | deco* class
sprimary = id | NUM | STR | RX | template | 'this' | 'super' | 'null' | 'true' | 'false' | P:expr | Q:elements | 'new' '.' name | 'import' (P:args | '.' name) | '#' name
template = TPL (P:expr)*
args = ('...'? assign (',' '...'? assign)* ','?)?
elements = ','* ('...'? assign (','+ '...'? assign)*)? ','*
object = (prop (',' prop)* ','?)?
prop = '...' assign | id ('=' assign)? | propname ':' assign | method
propname = name | STR | NUM | Q:assign | '#' name
import = 'import' (STR | @IMPORTTYPE (id (',' (B:imports | '*' 'as' id))? | B:imports | '*' 'as' id) 'from' STR) attributes? eos
attributes = ('with' | 'assert') B:object
imports = (@IMPORTTYPE (name | STR) ('as' id)? (',' @IMPORTTYPE (name | STR) ('as' id)?)* ','?)?
exports = (@IMPORTTYPE (name | STR) ('as' (name | STR))? (',' @IMPORTTYPE (name | STR) ('as' (name | STR))?)* ','?)?
export = deco* 'export' ('default' (func | deco* class | dexpr eos @EXPORTDEFAULT) | @IMPORTTYPE B:exports ('from' STR attributes?)? eos | @IMPORTTYPE '*' ('as' (name | STR))? 'from' STR attributes? eos | var eos | fdecl | deco* classdecl @EXPORT)
dexpr = assign
id = ID | @CONTEXT
name = id | @RESERVED
"""
_JS = {
    "@ITEM": "export", "@STMT": "fdecl", "@CDECL": "", "@BODY": "B:block", "@PARAMMODS": "", "@THIS": "", "@OPT": "none", "@BANG": "none", "@ABSTRACT": "", "@TARGS": "", "@IMPLEMENTS": "", "@MODS": "'static'", "@INDEXFIELD": "",
    "@ASTYPE1": "", "@ASTYPE": "", "@TYPEASSERT": "", "@SUFFIX": "", "@IMPORTTYPE": "", "@EXPORTDEFAULT": "", "@EXPORT": "",
}
_TS = {
    "@ITEM": "'import' id '=' ('require' P:args | id ('.' name)*) eos", "@STMT": "types", "@CDECL": "| id ':' type", "@BODY": "(B:block | eos)", "@PARAMMODS": "modifier*", "@THIS": "| 'this' tann", "@OPT": "'?'?", "@BANG": "'!'", "@ABSTRACT": "'abstract'?", "@TARGS": "targs?",
    "@IMPLEMENTS": "('implements' type (',' type)*)?", "@MODS": "modifier", "@INDEXFIELD": "| Q:indexer tann",
    "@ASTYPE1": "(('as' | 'satisfies') type)+ (BINARY unary @ASTYPE)* ('?' assign ':' assign)?", "@ASTYPE": "(('as' | 'satisfies') type)*", "@TYPEASSERT": "| '<' type '>' unary", "@SUFFIX": "| '!' | targs (P:args | template) | '?.' targs P:args",
    "@IMPORTTYPE": "'type'?", "@EXPORTDEFAULT": "| interface", "@EXPORT": "| types | '=' expr eos | 'as' 'namespace' id eos | 'import' id '=' ('require' P:args | id ('.' name)*) eos",
}
_JS_TYPES = """
none =
tann =
rettype =
typarams =
"""
_TS_TYPES = """
none =
modifier = 'public' | 'private' | 'protected' | 'readonly' | 'static' | 'abstract' | 'override' | 'declare' | 'async' | 'accessor'
tann = (':' type)?
rettype = (':' result)?
result = type | 'asserts' (id | 'this') ('is' type)? | (id | 'this') 'is' type
types = 'declare'? (interface | 'type' id typarams '=' type eos | 'const'? 'enum' id B:enum | ('namespace' | 'module') (id ('.' name)* | STR) (B:file | eos) | 'abstract' 'class' id typarams ('extends' lhs targs?)? ('implements' type (',' type)*)? B:classbody)
  | 'declare' (var eos | fdecl | classdecl | 'global' B:file) | 'global' B:file
interface = 'interface' id typarams ('extends' type (',' type)*)? B:typebody
enum = (propname ('=' assign)? (',' propname ('=' assign)?)* ','?)?
typarams = ('<' typaram (',' typaram)* ','? '>')?
typaram = ('const' | 'in' | 'out')* id ('extends' type)? ('=' type)?
targs = '<' type (',' type)* ','? '>'
type = union ('extends' union '?' type ':' type)?
union = ('|' | '&')? postfixtype (('|' | '&') postfixtype)*
postfixtype = ('keyof' | 'unique' | 'readonly' | 'infer')* (simpletype (Q:index)* | 'infer' id 'extends' union)
simpletype = id ('.' name)* targs? | STR | '-'? NUM | template | 'null' | 'true' | 'false' | 'void' | 'this' | 'const' | 'typeof' ('import' P:args ('.' name)* | (id | 'this') ('.' name)*) targs? | 'import' P:args ('.' name)* targs?
  | P:type | 'abstract'? 'new' typarams P:params '=>' result | typarams P:params '=>' result | B:typebody | Q:tuple
index = type?
template_ = TPL
tuple = (telement (',' telement)* ','?)?
telement = '...'? (name '?'? ':')? type '?'?
typebody = (tmember ((';' | ',' | ASI) tmember?)*)?
tmember = ('readonly' | '+' 'readonly' | '-' 'readonly' | 'static')* ((propname | Q:indexer) ('?' | ('-' | '+') '?')? (':' type)? | ('get' | 'set')? (propname | Q:indexer) '?'? typarams P:params rettype | 'new'? typarams P:params rettype)
indexer = id ':' type | id 'in' type ('as' type)? | expr
"""


def _script(parts: dict[str, str], types: str, context: list[str]) -> str:
    text = _SCRIPT
    parts = parts | {"@CONTEXT": _any(context), "@RESERVED": _any(JS_RESERVED)}
    for _ in range(2):
        for key in sorted(parts, key=len, reverse=True):
            text = text.replace(key, parts[key])
    text = text.replace("BINARY", "binary").replace("PREFIX", "prefix")
    if types is _TS_TYPES:
        types = types.replace("template_ = TPL\n", "")
        text = text.replace("template = TPL (P:expr)*", "template = TPL (P:expr | P:type)*")
    return text + types


GO = """
file = 'package' ID ';' (ispec ';' | ';')* (top? ';')* top?
ispec = 'import' (import | P:imports)
import = ('.' | ID)? STR
imports = (import (';' import)* ';'?)?
top = decl | 'func' P:params? ID (Q:tparams)? P:params result? (B:block)?
decl = 'var' (vspec | P:vspecs) | 'const' (cspec | P:cspecs) | 'type' (tspec | P:tspecs)
ids = ID (',' ID)*
vspecs = (vspec (';' vspec)* ';'?)?
cspecs = (cspec (';' cspec)* ';'?)?
tspecs = (tspec (';' tspec)* ';'?)?
vspec = ids (type ('=' exprs)? | '=' exprs)
cspec = ids (type? '=' exprs)?
tspec = ID (Q:tparams)? '='? type
tname = ID ('.' ID)? (Q:types)?
types = type (',' type)* ','?
type = tname | '*' type | Q:length type | 'map' Q:type type | 'chan' '<-'? type | '<-' 'chan' type | 'func' P:params result? | 'struct' B:fields | 'interface' B:methods | P:type
length = (expr | '...')?
params = (param (',' param)* ','?)?
param = ID? '...'? type
result = type | P:params
fields = (field (';' field)* ';'?)?
field = (ids type | '*'? tname) STR?
methods = (method (';' method)* ';'?)?
method = ID P:params result? | union
union = '~'? type ('|' '~'? type)*
tparams = ids union (',' ids union)* ','?
block = stmt? (';' stmt?)*
stmt = decl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | B:block | if | switch | 'select' B:comms | for | 'go' expr | 'defer' expr | ID ':' stmt?
simple = exprs (assignop exprs | '++' | '--' | '<-' expr)?
assignop = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
if = 'if' (simple? ';')? simple B:block ('else' (if | B:block))?
switch = 'switch' (simple? ';')? (simple | (ID ':=')? primary '.' P:typeword)? B:cases
typeword = 'type'
cases = (('case' typelist | 'default') ':' block)*
typelist = argument (',' argument)* ','?
comms = (('case' simple | 'default') ':' block)*
for = 'for' (simple | simple? ';' expr? ';' simple? | (exprs (':=' | '='))? 'range' expr)? B:block
exprs = expr (',' expr)*
expr = unary (binary unary)*
binary = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | primary
primary = operand (suffix)*
operand = ID | NUM | STR | P:argument | 'func' P:params result? B:block | literaltype B:literal | chantype P:args | Q:length type P:args | 'interface' B:methods P:args | 'map' Q:type type P:args | 'struct' B:fields B:literal
chantype = 'chan' '<-'? type | '<-' 'chan' type
literaltype = Q:length type | 'map' Q:type type | 'struct' B:fields
suffix = '.' ID | '.' P:type | Q:index | P:args | B:literal
args = (argument (',' argument)* '...'? ','?)?
argument = expr | type
index = argument (',' argument)* ','? | expr? ':' expr? (':' expr)?
literal = (keyed (',' keyed)* ','?)?
keyed = (expr | B:literal) (':' (expr | B:literal))?
"""

JAVA = """
file = (annotation* 'package' qualified ';')? (import | ';')* (typedecl | ';')* | import* annotation* 'open'? 'module' qualified B:module
module = (ID (ID | 'transient' | 'static')* (qualified (ID qualified (',' qualified)* | 'to' qualified | 'with' qualified)?) (',' qualified)* ';')*
import = 'import' 'static'? qualified ('.' '*')? ';'
qualified = id ('.' id)*
id = ID | 'record' | 'sealed' | 'permits' | 'yield' | 'when' | 'open' | 'module'
mods = (modifier | annotation)*
modifier = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed'
annotation = '@' qualified (P:annotationargs)?
annotationargs = (value (',' value)* ','?)? | id '=' value (',' id '=' value)*
value = expr | B:values | annotation
values = (value (',' value)*)? ','?
typedecl = mods (class | interface | enum | record | annotationtype)
class = 'class' id typarams ('extends' type)? ('implements' types)? ('permits' types)? B:classbody
interface = 'interface' id typarams ('extends' types)? ('permits' types)? B:classbody
annotationtype = '@' 'interface' id B:classbody
enum = 'enum' id ('implements' types)? B:enumbody
enumbody = (constant (',' constant)*)? ','? (';' member*)?
constant = annotation* id (P:args)? (B:classbody)?
record = 'record' id typarams P:components ('implements' types)? B:classbody
components = (mods type '...'? id (',' mods type '...'? id)*)?
classbody = member*
member = ';' | 'static'? B:block | mods (class | interface | enum | record | annotationtype | field | method | constructor)
field = type declarators ';'
declarators = declarator (',' declarator)*
declarator = id dims ('=' init)?
init = expr | B:inits
inits = (init (',' init)*)? ','?
dims = (annotation* Q:none)*
none =
method = typarams annotation* ('void' | type) id P:params dims ('throws' types)? (B:block | ('default' value)? ';')
constructor = typarams id P:params ('throws' types)? B:block | id B:block
params = (param (',' param)*)?
param = mods type (annotation* '...')? (id dims | (id '.')? 'this')
typarams = ('<' typaram (',' typaram)* '>')?
typaram = annotation* id ('extends' type ('&' type)*)?
types = type (',' type)*
type = annotation* (primitive | id targs? ('.' annotation* id targs?)*) dims
primitive = 'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double'
targs = '<' (targ (',' targ)*)? '>'
targ = annotation* ('?' (('extends' | 'super') type)? | type)
block = blockstmt*
blockstmt = local ';' | mods (class | enum | record | interface) | stmt
local = mods type declarators
stmt = B:block | ';' | expr ';' | 'if' P:expr stmt ('else' stmt)? | 'while' P:expr stmt | 'do' stmt 'while' P:expr ';' | 'for' P:forhead stmt | switch | 'return' expr? ';' | 'throw' expr ';' | 'break' id? ';' | 'continue' id? ';'
  | 'try' (P:resources)? B:block ('catch' P:catchparam B:block)* ('finally' B:block)? @TRY | 'synchronized' P:expr B:block | 'assert' expr (':' expr)? ';' | id ':' stmt | 'yield' expr ';'
catchparam = mods type ('|' type)* id
resources = resource (';' resource)* ';'?
resource = local | expr
forhead = (local | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? | mods type id dims ':' expr
switch = 'switch' P:expr B:switchbody
switchbody = (label ':' blockstmt* | label '->' (expr ';' | B:block | 'throw' expr ';'))*
label = 'case' labelvalue (',' labelvalue)* ('when' expr)? | 'default'
labelvalue = expr | pattern | 'default'
pattern = mods type id | type P:patterns id?
patterns = (pattern (',' pattern)*)?
expr = unary (binary unary | 'instanceof' (mods type id? | pattern))* ('?' expr ':' expr)?
binary = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' '>'? | '>' '>'? '>=' | '+' | '-' | '*' | '/' | '%'
lambda = (id | P:lambdaparams) '->' (expr | B:block)
lambdaparams = params | (id (',' id)*)?
unary = ('+' | '-' | '!' | '~' | '++' | '--') unary | P:cast castable | lambda | primary suffix* ('++' | '--')*
castable = ('!' | '~') unary | P:cast castable | lambda | primary suffix* ('++' | '--')* | ('+' | '-') unary
cast = type ('&' type)*
primary = id | NUM | STR | 'true' | 'false' | 'null' | 'this' | 'super' | P:expr | new | switch | (primitive dims | 'void') '.' 'class' | id ('.' id)* (annotation* Q:none)+ '.' 'class' | type '::' targs? (id | 'new')
suffix = '.' targs? (id | 'this' | 'super' | 'class') | '.' new | P:args | Q:expr | '::' targs? (id | 'new')
new = 'new' annotation* targs? (primitive | id targs? ('.' annotation* id targs?)*) (P:args (B:classbody)? | (annotation* Q:expr)+ dims | dims1 B:inits)
dims1 = (annotation* Q:none)+
args = (expr (',' expr)*)?
""".replace("('catch' P:catchparam B:block)* ('finally' B:block)? @TRY", "(('catch' P:catchparam B:block)+ ('finally' B:block)? | 'finally' B:block) | 'try' P:resources B:block")

C = """
file = external*
external = ';' | CONST | macro? funcdef | macro? declaration | 'extern' STR (B:file | external) | id P:args ';'? | assert | asm ';'
macro = CONST (P:args)? | id | id P:args
assert = ('_Static_assert' | 'static_assert') P:args ';'
qualifier = 'const' | 'volatile' | 'restrict' | '_Atomic' | 'static' | 'extern' | 'inline' | 'register' | 'auto' | 'typedef' | '_Noreturn' | '_Thread_local' | '_Alignas' P:typeargs | mark
mark = ATTR | CONST (P:args)?
primitive = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex'
specs = qualifier* (primitive (primitive | qualifier)* | (record | enum | id | CONST P:args | 'typeof' P:typeargs | '_Atomic' P:typeargs) qualifier*)
typeargs = typename | expr
record = ('struct' | 'union') mark* (id | id? B:fields mark*)
enum = 'enum' mark* (id | id? (':' specs)? B:enumerators mark*)
enumerators = enumerator (',' enumerator)* ','?
enumerator = id mark* ('=' cond)?
fields = (specs (fdecl (',' fdecl)*)? ';' | assert | ';' | id P:args ';' | CONST (P:args)?)*
fdecl = declarator (':' cond)? mark* | ':' cond
declaration = specs (initdecl (',' initdecl)*)? ';'
initdecl = declarator asm? mark* ('=' init)?
init = assign | B:inits
inits = (designated (',' designated)* ','?)?
designated = ((Q:range | '.' id)+ '=' | id ':')? init
range = cond ('...' cond)?
declarator = ('*' qualifier*)* mark* direct
direct = (id | P:declarator) (Q:bounds | P:params)*
bounds = qualifier* (assign | '*')?
params = (param (',' param)* (',' '...')? | '...')?
param = specs (declarator | abstract)? mark*
abstract = ('*' qualifier*)+ (P:abstract | Q:bounds | P:params)* | (P:abstract | Q:bounds | P:params)+
typename = specs abstract?
fdeclarator = ('*' qualifier*)* mark* (id | P:declarator) (Q:bounds)* P:params (Q:bounds | P:params)*
funcdef = specs mark* fdeclarator mark* declaration* B:block | id (P:params) declaration* B:block | qualifier+ id P:params B:block
block = (blockitem)*
blockitem = CONST P:args | declaration | stmt | label | id P:args B:block | assert
label = id ':' mark* | 'case' cond ('...' cond)? ':' | 'default' ':'
stmt = B:block | ';' | ATTR ';' | expr ';' | 'if' P:expr stmt ('else' stmt)? | 'while' P:expr stmt | 'do' stmt 'while' P:expr ';' | 'for' P:forhead stmt | 'switch' P:expr stmt | 'goto' ('*' unary | id) ';' | 'return' expr? ';' | 'return' B:inits ';' | 'break' ';' | 'continue' ';' | label stmt | asm ';' | id P:args stmt_
stmt_ = 'if' P:expr stmt ('else' stmt)? | 'for' P:forhead stmt | 'while' P:expr stmt
asm = 'asm' ('volatile' | 'goto' | 'inline')* P:asmbody
asmbody = (asmpart ((':' | '::') asmpart?)* | ((':' | '::') asmpart?)+)?
asmpart = asmop (',' asmop)*
asmop = (Q:expr)? string (P:expr)? | id
forhead = (expr? ';' | declaration) expr? ';' expr?
expr = assign (',' assign)*
cond = assign
assign = unary (binary unary)* ('?' expr? ':' assign)?
binary = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%'
unary = ('++' | '--' | '+' | '-' | '!' | '~' | '*' | '&' | '&&') unary | 'sizeof' (unary | P:typename) | '_Alignof' P:typename | P:typename (unary | B:inits suffix*) | primary suffix*
primary = id | NUM | string | P:expr | P:stmtexpr | '_Generic' P:generic
string = STR (STR | id)*
stmtexpr = B:block
generic = assign (',' (typename | 'default') ':' assign)+
suffix = P:args | Q:expr | '.' id | '->' id | '++' | '--'
args = (arg (',' arg)*)?
arg = assign | typename | (binary | record | B:block)?
id = ID | CONST
"""

RUST = """
file = item*
item = attrs vis? (use | fn | struct | enum | union | trait | impl | mod | const | static | alias | extern) | attrs macroitem | attrs ';'
attrs = ('#' '!'? Q:none)*
none =
vis = 'pub' (P:vispath)? | 'crate'
vispath = 'in'? path
use = 'use' usetree ';'
usetree = '::'? (name '::')* (name ('as' (id | '_'))? | '*' | B:usetrees)
usetrees = (usetree (',' usetree)* ','?)?
name = id | 'self' | 'super' | 'crate' | 'Self'
fn = ('const' | 'async' | 'unsafe' | 'safe' | 'default' | 'extern' STR?)* 'fn' id gparams P:params ('->' type)? where? (B:block | ';')
params = (attrs param (',' attrs param)* ','?)?
param = '&' LT? 'mut'? 'self' | 'mut'? 'self' (':' type)? | pat ':' (type | '...') | '...'
gparams = ('<' (gparam (',' gparam)* ','?)? '>')?
gparam = attrs (LT (':' bounds?)? | id (':' bounds?)? ('=' type)? | 'const' id ':' type ('=' (B:block | '-'? NUM | STR | id | 'true' | 'false'))?)
where = 'where' (wherepred (',' wherepred)* ','?)?
wherepred = LT ':' bounds? | forlt? type ':' bounds?
forlt = 'for' '<' (LT (',' LT)* ','?)? '>'
bounds = bound ('+' bound)* '+'?
bound = LT | ('?' | '~' 'const' | 'const')? forlt? path | P:bound | 'use' '<' (LT | id | ',' | 'Self')* '>'
struct = 'struct' id gparams (where? B:fields | where? ';' | P:tuplefields where? ';')
union = 'union' id gparams where? B:fields
fields = (attrs vis? id ':' type ('=' expr)? (',' attrs vis? id ':' type ('=' expr)?)* ','?)?
tuplefields = (attrs vis? type (',' attrs vis? type)* ','?)?
enum = 'enum' id gparams where? B:variants
variants = (variant (',' variant)* ','?)?
variant = attrs vis? id (B:fields | P:tuplefields)? ('=' expr)?
trait = ('unsafe' | 'auto')* 'trait' id gparams (':' bounds?)? where? (B:file | '=' bounds ';')
impl = 'default'? 'unsafe'? 'impl' gparams 'const'? ('!'? type 'for')? type where? B:file
mod = 'unsafe'? 'mod' id (';' | B:file)
const = 'default'? 'const' (id | '_') gparams (':' type)? ('=' expr)? where? ';'
static = ('unsafe' | 'safe')? 'static' 'mut'? id ':' type ('=' expr)? ';'
alias = 'default'? 'type' id gparams (':' bounds?)? where? ('=' type)? where? ';'
extern = 'extern' 'crate' name ('as' (id | '_'))? ';' | 'unsafe'? 'extern' STR? B:file
macroitem = path '!' id? (B:none | (P:none | Q:none) ';')
path = '::'? seg ('::' seg)* | '<' type ('as' path)? '>' ('::' seg)+
seg = name ('::'? '<' gargs '>' | '::'? P:types ('->' type)?)?
gargs = (garg (',' garg)* ','?)?
garg = LT | type | id ('<' gargs '>')? ('=' type | ':' bounds) | '-'? NUM | STR | B:block | 'true' | 'false'
types = (type (',' type)* ','?)?
type = path | '&' LT? 'mut'? type | '&&' LT? 'mut'? type | '*' ('const' | 'mut') type | Q:array | P:types | ('unsafe' | 'extern' STR?)* 'fn' P:fnparams ('->' type)? | 'impl' bounds | 'dyn' bounds | '!' | '_' | path '!' (P:none | Q:none | B:none) | forlt type | LT ('+' bound)+
fnparams = (attrs (name ':' | '_' ':')? type (',' attrs (name ':' | '_' ':')? type)* (',' '...')? ','?)? | '...'
array = type (';' expr)?
block = ('#' '!' Q:none)* stmt* (attrs expr)?
stmt = item | attrs 'let' pat (':' type)? ('=' expr ('else' B:block)?)? ';' | attrs expr ';' | attrs blocklike | attrs blocklike postfix+ (binary unary)* ';'
blocklike = (LT ':')? ('loop' B:block | 'while' expr B:block | 'for' pat 'in' expr B:block | B:block) | if | match | ('unsafe' | 'async' 'move'? | 'const') B:block | path '!' B:none
if = 'if' expr B:block ('else' (if | B:block))?
match = 'match' expr B:arms
arms = ('#' '!' Q:none)* (arm* lastarm)?
arm = attrs '|'? pat ('if' expr)? '=>' (expr ',' | blocklike)
lastarm = attrs '|'? pat ('if' expr)? '=>' expr ','?
expr = unary (binary unary)* ('..' | '..=')? | '..'
binary = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '>' '>=' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<' '<' | '>' '>' | '+' | '-' | '*' | '/' | '%' | '..' | '..='
unary = ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('mut' | 'const') | '..' | '..=') unary | 'let' pat '=' unary | closure | primary postfix* ('as' type postfix*)* | 'return' expr? | 'break' LT? expr? | 'continue' LT? | 'yield' expr?
closure = forlt? ('static' | 'const' | 'async')* 'move'? ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type B:block | expr)
cparam = attrs pat1 (':' type)?
postfix = '?' | '.' name ('::' '<' gargs '>')? | '.' NUM | '.' 'await' | P:args | Q:expr
args = (attrs expr (',' attrs expr)* ','?)?
primary = path | path B:structlit | NUM | STR | 'true' | 'false' | '_' | P:args | Q:arrayexpr | path '!' (P:none | Q:none | B:none) | blocklike
arrayexpr = args | expr ';' expr
structlit = (attrs fieldinit (',' attrs fieldinit)* (',' | ',' '..' expr?)? | '..' expr?)?
fieldinit = (name | NUM) (':' expr)?
pat = '|'? pat1 ('|' pat1)*
pat1 = literal | literal? ('..=' | '..' | '...') literal? | 'ref'? 'mut'? id ('@' pat1)? | path | path P:pats | path B:fieldpats | '&' 'mut'? pat1 | '&&' 'mut'? pat1 | P:pats | Q:pats | '_' | '..' | path '!' (P:none | Q:none | B:none) | 'mut'? 'self' | 'const' B:block
literal = '-'? NUM | STR | 'true' | 'false' | path
pats = (pat (',' pat)* ','?)?
fieldpats = (attrs fieldpat (',' attrs fieldpat)* ','?)?
fieldpat = (name | NUM) ':' pat | 'ref'? 'mut'? id | '..'
id = ID | 'union' | 'default' | 'auto' | 'safe' | 'raw'
"""

PYTHON = """
file = stmt*
block = stmt+
suite = simple NL | NL N:block
stmt = simple NL | compound
simple = small (';' small)* ';'?
small = stars (augassign (yield | exprs) | ('=' (yield | stars))+ | ':' expr ('=' (yield | stars))?)? | yield | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)? | 'global' ids | 'nonlocal' ids | 'del' stars | 'assert' expr (',' expr)?
  | 'import' dotted ('as' id)? (',' dotted ('as' id)?)* | 'from' ('.' | '...')* dotted 'import' names | 'from' ('.' | '...')+ 'import' names | 'type' id (Q:tparams)? '=' expr
names = '*' | id ('as' id)? (',' id ('as' id)?)* | P:namelist
namelist = id ('as' id)? (',' id ('as' id)?)* ','?
dotted = id ('.' id)*
ids = id (',' id)*
id = ID | @SOFT
augassign = '+=' | '-=' | '*=' | '@=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '//='
compound = ('@' named NL)* ('async'? 'def' id (Q:tparams)? P:params ('->' exprs)? ':' suite | 'class' id (Q:tparams)? (P:args)? ':' suite)
  | 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? | 'while' named ':' suite ('else' ':' suite)? | 'async'? 'for' targets 'in' stars ':' suite ('else' ':' suite)?
  | 'try' ':' suite (('except' '*'? (expr ('as' id)? | expr (',' expr)+)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
  | 'async'? 'with' (item (',' item)* | P:items) ':' suite | 'match' subject ':' NL N:cases
item = expr ('as' starred)?
items = item (',' item)* ','?
subject = named (',' named)* ','? | '*' expr (',' ('*'? expr)?)*
cases = ('case' pats ('if' named)? ':' suite)+
pats = pat (',' pat)* ','?
pat = orpat ('as' id)? | '*' id
orpat = closed ('|' closed)*
closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted (P:patargs)? | P:patgroup | Q:patgroup | B:patmap
patgroup = (pat (',' pat)* ','?)?
patargs = ((id '=')? pat (',' (id '=')? pat)* ','?)?
patmap = (patkey (',' patkey)* ','?)?
patkey = ('-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted) ':' pat | '**' id
tparams = ('*' | '**')? id (':' expr)? ('=' expr)? (',' ('*' | '**')? id (':' expr)? ('=' expr)?)* ','?
params = (param (',' param)* ','?)?
param = id (':' expr)? ('=' expr)? | '*' (id (':' starred)?)? | '**' id (':' expr)? | '/'
lparams = (lparam (',' lparam)* ','?)?
lparam = id ('=' expr)? | '*' id? | '**' id | '/'
targets = target (',' target)* ','?
target = '*'? primary
stars = starred (',' starred)* ','?
starred = '*'? expr
exprs = expr (',' starred)* ','?
named = (id ':=')? expr
expr = or ('if' or 'else' expr)? | 'lambda' lparams ':' expr
or = not (('and' | 'or') not)*
not = 'not'* comparison
comparison = sum (compop sum)*
compop = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
sum = unary (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '|' | '^' | '&' | '<<' | '>>' | '**') unary)*
unary = ('+' | '-' | '~') unary | 'await'? primary
primary = atom ('.' id | P:args | Q:slices)*
atom = id | NUM | STR+ | 'None' | 'True' | 'False' | '...' | P:group | Q:list | B:braces
yield = 'yield' ('from' expr | stars)?
group = yield | comp | (element (',' element)* ','?)?
list = comp | (element (',' element)* ','?)?
element = '*' expr | named
comp = element compfor+
compfor = 'async'? 'for' targets 'in' or ('if' cond)*
cond = or | 'lambda' lparams ':' expr | id ':=' or
braces = (pair (',' pair)* ','?)? | expr ':' expr compfor+ | comp | element (',' element)* ','?
pair = expr ':' expr | '**' expr
args = (arg (',' arg)* ','?)? | named compfor+
arg = named | id '=' expr | '*' expr | '**' expr
slices = slice (',' slice)* ','?
slice = expr? ':' expr? (':' expr?)? | named | '*' expr
"""

RUBY = """
file = body
body = stmt? (sep stmt?)*
sep = ';' | NL
stmt = expr (('§if' | '§unless' | '§while' | '§until' | '§rescue') expr)* | 'alias' fname fname | 'undef' fname (',' fname)* | K.BEGIN_:none
none =
fname = name | SYM | op
op = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '===' | '<<' | '>>' | '!' | '=~' | '!~' | '&' | '|' | '^' | '~' | Q:none '='? | '+@' | '-@' | '`'
name = ID | CONST | @NAMES
expr = notexpr (('and' | 'or') nls notexpr)*
notexpr = ('not' | '!')* command
command = arg | mlhs '=' nls rhs | callee cargs (doblock)? chain* | ('return' | 'break' | 'next') cargs? | ('yield' | 'super') cargs doblock? | arg opassign nls command | 'defined?' arg
chain = ('.' | '&.') name (P:args)? doblock? | ('.' | '&.') name cargs doblock?
callee = (ID | CONST) | primary (('.' | '&.' | '::') name)
cargs = carg (',' nls carg)*
carg = '*' arg | '**' arg | '&' arg | (LABEL | STR ':') nls arg? | arg ('=>' nls arg)? | command2 | '*' | '&' | '**'
command2 = callee cargs
mlhs = mitem (',' mitem)* ','?
mitem = '*'? primary | P:mlhs | '*'
rhs = '*'? arg (',' nls '*'? arg)* | command
opassign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '||=' | '&&=' | '|=' | '&=' | '^=' | '<<=' | '>>='
nls = NL*
arg = unary (binary nls unary | opassign nls (rescued | '*' arg))* ('?' nls arg nls (':' | LABELEND) nls arg)? (('..' | '...'))?
rescued = arg ('§rescue' arg)?
binary = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '===' | '<<' | '>>' | '=~' | '!~' | '&' | '|' | '^' | '&&' | '||' | '..' | '...'
unary = ('-' | '+' | '!' | '~' | '..' | '...' | '&' | '::') unary | 'not' unary | 'defined?' unary | primary
primary = atom suffix*
suffix = ('.' | '&.' | '::') (name (P:args)? | P:args | Q:args) | Q:args | P:args | B:blk | K.do:dobody
doblock = K.do:dobody | B:blk
blk = ('|' bparams '|' | '||')? body
dobody = ('|' bparams '|' | '||')? bodystmt
bparams = (bparam ((',' | ';') nls bparam)* ','?)?
bparam = ID ('=' arg)? | '*' ID? | '**' (ID | 'nil')? | '&' ID? | LABEL arg? | P:bparams | '...'
atom = ID | CONST | NUM | STR+ | SYM | RX | 'self' | 'nil' | 'true' | 'false' | '__method__' | P:paren | Q:args | B:hash | 'super' | 'yield' | 'redo' | 'retry' | lambda | group | endless | 'return' | 'break' | 'next'
paren = body
lambda = '->' (P:bparams | bparams) (B:blk | K.do:dobody)
args = nls (carg nls (',' nls carg nls)* ','? nls | '...')?
hash = nls (pair nls (',' nls pair nls)* ','? nls)?
pair = '**' arg | (LABEL | STR ':') nls arg? | arg nls '=>' nls arg | LABEL
endless = 'edef' DEFNAME (P:fparams)? '=' nls (command ('§rescue' arg)?)
group = K.def:def | K.class:class | K.module:module | K.begin:bodystmt | K.case:case | K.if:if | K.unless:if | K.while:while | K.until:while | K.for:for
def = DEFNAME (P:fparams | fparams) sep bodystmt | DEFNAME P:fparams bodystmt
fparams = nls (fparam nls (',' nls fparam nls)* nls)?
fparam = ID ('=' arg)? | LABEL arg? | '*' ID? | '**' (ID | 'nil')? | '&' ID? | '...' | P:fparams
class = ('::'? CONST ('::' CONST)* ('<' expr)? | '<<' expr | primary '::' CONST) sep bodystmt
module = '::'? CONST ('::' CONST)* sep bodystmt
bodystmt = body ('rescue' rescuelist ('then' | sep) body)* ('else' body)? ('ensure' body)?
rescuelist = ('*'? arg (',' nls '*'? arg)*)? ('=>' primary)?
then = sep* 'then' | sep
if = stmt then body ('elsif' stmt then body)* ('else' body)?
while = stmt sep body | stmt 'then' body
for = mlhs 'in' stmt (sep | 'then') body
case = stmt? sep* ('when' '*'? arg (',' nls '*'? arg)* then body)+ ('else' body)? | stmt sep* ('in' pattern (('§if' | '§unless') expr)? then body)+ ('else' body)?
pattern = ptop (',' nls ptop)* ','?
ptop = palt ('=>' ID)? | '*' ID? | LABEL palt?
palt = pprim ('|' pprim)*
pprim = ('^')? primary | unary (('..' | '...') unary?)? | Q:pattern | B:phash | CONST P:pattern
phash = (LABEL palt? | '**' (ID | 'nil')) (',' nls (LABEL palt? | '**' (ID | 'nil')))* ','?
"""

SHELL = """
file = list?
list = NL* andor (sep andor)* sep?
sep = (';' | '&') NL* | NL+
andor = pipeline (('&&' | '||') NL* pipeline)*
pipeline = ('!' | 'time')* command (('|' | '|&') NL* command)*
command = simple | (P:list | B:list | K.if:if | K.case:case | ('while' | 'until') list K.do:list | 'for' WORD (NL* 'in' WORD*)? sep? K.do:list | 'for' ARITH sep? (K.do:list | B:list) | 'select' WORD (NL* 'in' WORD*)? sep? K.do:list | ARITH | COND) redirect* | function
function = WORD P:none NL* compound redirect* | 'function' WORD (P:none)? NL* compound redirect*
compound = P:list | B:list | K.if:if | K.case:case | ('while' | 'until') list K.do:list | 'for' WORD (NL* 'in' WORD*)? sep? K.do:list | COND | ARITH
none =
simple = (WORD | ARRAY | redirect)+
redirect = REDIR WORD
if = list 'then' list ('elif' list 'then' list)* ('else' list)?
case = WORD NL* 'in' NL* (arm (ARMEND NL* arm)* (ARMEND NL*)?)?
arm = ARM NL* list? NL*
"""

GRAMMARS: dict[str, Machine] = {}
for _lang, _text, _closers, _soft in (
    ("javascript", _script(_JS, _JS_TYPES, JS_CONTEXT), None, True),
    ("typescript", _script(_TS, _TS_TYPES, JS_CONTEXT + TS_CONTEXT), None, True),
    ("go", GO, None, False),
    ("java", JAVA, None, False),
    ("c", C, None, False),
    ("rust", RUST, None, False),
    ("python", PYTHON.replace("@SOFT", _any(PY_SOFT)), None, False),
    ("ruby", RUBY.replace("@NAMES", _any(RUBY_RESERVED)), dict.fromkeys("def class module begin case if unless while until for do BEGIN_".split(), "end"), False),
    ("shell", SHELL, {"if": "fi", "case": "esac", "do": "done"}, False),
):
    GRAMMARS[_lang] = Machine(_text, _closers, _soft)
