"""Grammars of the languages whose files are checked, over tokens with collapsed brackets (see chart.py).

They describe syntax only: operator precedence doesn't matter for validity, so an expression is a chain.
`i` is an identifier, `n` a number, `s` a string or other literal.
"""

GO = """
%BOP = + / % == != < <= > >= && || | ^ << >> &^ . -
%ASG = += -= *= /= %= |= &= ^= <<= >>= &^= =
package : 'package' 'i'
import : 'import' ( importspec | P:importspecs )
importspec : 'i'? 's' | '.' 's' |
decl : func | 'var' ( varspec | P:varspecs ) | 'const' ( constspec | P:constspecs ) | 'type' ( typespec | P:typespecs ) |
varspec : ids type ( '=' exprs )? | ids '=' exprs |
constspec : ids ( type? '=' exprs )? |
typespec : 'i' B:tparams? '='? type |
ids : 'i' ( ',' 'i' )*
func : 'func' P:params? 'i' B:tparams? P:params result? C:block?
result : type | P:params
type : tname | '*' type | B:arr type | 'map' B:typeargs type | 'chan' type | '<-' 'chan' type | 'chan' '<-' type
  | 'func' P:params result? | 'struct' C:fields | 'interface' C:iface | P:onetype
tname : 'i' ( '.' 'i' )? B:typeargs?
onetype : type
arr : expr? | '...'
typeargs : type ( ',' type )* ','?
tparams : ( 'i' ( union )? ( ',' 'i' ( union )? )* ','? )?
union : '~'? type ( '|' '~'? type )*
params : ( anonymous | named )?
anonymous : '...'? type ( ',' '...'? type )* ','?
named : ( 'i' ',' )* 'i' '...'? type ( ',' ( 'i' ',' )* 'i' '...'? type )* ','?
field : ids type 's'? | '*'? tname 's'? |
method : 'i' P:params result? | union |
stmt : stmt1? ( ';' stmt1? )*
stmt1 : simple | decl | 'return' exprs? | 'break' 'i'? | 'continue' 'i'? | 'goto' 'i' | 'fallthrough' | C:block | if | for | switch
  | 'select' C:select | 'go' call | 'defer' call | 'i' ':' stmt1
if : 'if' ( simple ';' )? simple C:block ( 'else' ( if | C:block ) )?
for : 'for' ( simple? ';' simple? ';' simple? | simple | range )? C:block
switch : 'switch' ( simple? ';' )? simple? C:switch
range : ( ids ':=' | exprs '=' )? 'range' expr
simple : expr | exprs %ASG exprs | ids ':=' exprs | expr '++' | expr '--' | expr '<-' expr
exprs : expr ( ',' expr )*
expr : un ( ( %BOP | '*' | '&' | '-' | '+' | '^' | '<' ) un )*
call : base ( '.' ( 'i' | P:assert ) | P:args | B:index | C:elems )* P:args
un : ( '-' | '+' | '!' | '^' | '*' | '&' | '<-' )* prim
prim : base ( '.' ( 'i' | P:assert ) | P:args | B:index | C:elems )*
base : 'n' | 's' | 'i' | P:paren | 'func' P:params result? C:block | B:arr type | 'map' B:typeargs type | 'struct' C:fields
  | 'interface' C:iface | 'chan' type
paren : expr | type
assert : type | 'type'
args : ( arg ( ',' arg )* '...'? ','? )?
arg : expr | type
index : expr ( ',' expr )* | typeargs | expr? ':' expr? ( ':' expr )?
elems : ( elem ( ',' elem )* ','? )?
elem : ( value ':' )? value
value : expr | C:elems
clause : ( ( 'case' caselist | 'default' ) ':' )+ stmt
caselist : arg ( ',' arg )*
comm : ( ( 'case' simple | 'default' ) ':' )+ stmt
"""

# Lists: content kind, name -> (unit kinds allowed first, unit kinds allowed later). Units are split at line ends and,
# but for statements, at semicolons.
GO_LISTS = {
    ("C", "block"): (("stmt",), ("stmt",)),
    ("C", "fields"): (("field",), ("field",)),
    ("C", "iface"): (("method",), ("method",)),
    ("C", "switch"): (("clause",), ("clause", "stmt")),
    ("C", "select"): (("comm",), ("comm", "stmt")),
    ("P", "importspecs"): (("importspec",), ("importspec",)),
    ("P", "varspecs"): (("varspec",), ("varspec",)),
    ("P", "constspecs"): (("constspec",), ("constspec",)),
    ("P", "typespecs"): (("typespec",), ("typespec",)),
    ("", "file"): (("package",), ("import", "decl")),
}

_JS = """
%BOP = / % == != === !== <= >= && || ?? | ^ << instanceof ** &
%ASG = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=
unit : ( closed )* stmt
stmt : simple | closed | open
something : said | closed | open
simple : said | nothing
said : vardecl | 'return' expr? | 'throw' expr | 'break' 'i'? | 'continue' 'i'? | 'debugger' | expr
nothing :
vardecl : VARDECL
target : id | B:array | C:object
closed : C:block | fndecl | classdecl | 'try' C:block ( 'catch' P:catchparam? C:block ( 'finally' C:block )? | 'finally' C:block ) | 'switch' P:expr C:switch
  | 'if' P:expr closed ( 'else' closed )? | ( 'while' P:expr | 'for' 'await'? P:forhdr | 'with' P:expr ) closed | id ':' closed CLOSED
open : 'if' P:expr ( stmt | ( something ';'? | ';' ) 'else' stmt ) | ( 'while' P:expr | 'for' 'await'? P:forhdr | 'with' P:expr ) stmt
  | 'do' stmt ';'? 'while' P:expr | id ':' stmt OPEN
catchparam : target ANN
forhdr : ( vardecl | expr )? ';' expr? ';' expr? | ( ( 'var' | 'let' | 'const' | 'using' ) target | assign ) ( 'of' assign | 'in' expr )
fn : 'async'? 'function' '*'? id? TPARAMS P:params ANN C:block
fndecl : 'async'? 'function' '*'? id TPARAMS P:params ANN C:block
class : DECOS 'class' id? TPARAMS ( 'extends' call TARGS )? IMPLEMENTS C:class
classdecl : DECOS 'class' id TPARAMS ( 'extends' call TARGS )? IMPLEMENTS C:class
expr : assign ( ',' assign )*
assign : arrow | 'yield' '*'? assign? | cond | lhs ( %ASG | '=' ) assign
lhs : id | call '.' '#'? word | call B:expr | P:expr | B:array | C:object LHS
arrow : 'async'? ( id | TPARAMS P:params ANN ) '=>' ( C:block | assign )
cond : bin ( '?' assign ':' assign )?
bin : operand ( op operand )*
op : %BOP | '+' | '-' | '*' | '<' | '>' | '>' '>' | '>' '>' '>' | 'in'
operand : un AS
un : ( '-' | '+' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' )* post
post : call ( '++' | '--' )?
call : 'new'* prim suffix*
prim : id | 'n' | 's' | 't' | 'super' | P:expr | B:array | C:object | fn | class | 'import' P:args | 'import' '.' 'i' | 'new' '.' 'i' | '#' 'i' PRIM
suffix : '.' '#'? word | '?.' ( '#'? word | P:args | B:expr ) | P:args | B:expr | 't' SUFFIX
array : ','* ( elem ( ',' elem? )* )?
elem : '...'? assign
args : ( elem ( ',' elem )* ','? )?
object : ( prop ( ',' prop )* ','? )?
prop : key ':' assign | id ( '=' assign )? | '...' assign | ( 'async' | 'get' | 'set' )? '*'? key TPARAMS P:params ANN C:block
key : word | 's' | 'n' | B:expr | '#' word
params : ( param ( ',' param )* ','? )?
param : PMODS '...'? target OPT ANN ( '=' assign )?
member : ( method )* ( method | field | nothing )
method : MODS 'static'? ( 'async' | 'get' | 'set' )? '*'? key OPT TPARAMS P:params ANN C:block | 'static' C:block
field : MODS ( 'static' )? ACCESS key FIELDMARK ANN ( '=' assign )? MEMBER
swfirst : label ( label | closed )* stmt | nothing
swunit : ( label | closed )* stmt
label : 'case' expr ':' | 'default' ':'
export : 'export' ( vardecl | closed | 'default' assign | 'default' closed | 'default' fn | 'default' class | '*' ( 'as' ( word | 's' ) )? 'from' 's' | C:exports ( 'from' 's' )? EXPORT ) ( closed )* stmt?
import : 'import' TYPEONLY ( 's' | ( id ( ',' ( C:exports | '*' 'as' id ) )? | C:exports | '*' 'as' id ) 'from' 's' ) ( 'with' C:object )? IMPORT
exports : ( spec ( ',' spec )* ','? )?
spec : TYPEONLY ( word | 's' ) ( 'as' ( word | 's' ) )?
id : 'i' | 'of' | 'as' | 'from' | 'get' | 'set' | 'async' | 'static' | 'using' IDS
"""

_JS_RESERVED = (
    "return throw break continue debugger var let const try catch finally switch if else while for with do function class extends yield typeof void delete "
    "await new super import in instanceof case default export"
)

_TS_MORE = """
closed : ( 'declare' | 'abstract' )+ closed | 'interface' id TPARAMS ( 'extends' type ( ',' type )* )? C:typebody
  | ( 'namespace' | 'module' ) ( id ( '.' word )* | 's' ) C:block | 'const'? 'enum' id C:enum | 'global' C:block
said : 'type' id TPARAMS '=' type | 'declare' said | 'import' id '=' expr | 'declare'? fnsig
fnsig : 'async'? 'function' '*'? id TPARAMS P:params ANN
type : fntype | ctype
fntype : 'abstract'? 'new'? TPARAMS P:params '=>' rettype
rettype : type | ( id | 'this' ) 'is' type | 'asserts' ( id | 'this' ) ( 'is' type )?
ctype : utype ( 'extends' utype '?' type ':' type )?
utype : '|'? itype ( '|' itype )*
itype : '&'? ptype ( '&' ptype )*
ptype : ( 'keyof' | 'readonly' | 'unique' | 'infer' )* ( atom | 'typeof' call )  ( B:typeindex )*
atom : id ( '.' word )* targs? | 'n' | '-' 'n' | 's' | 't' | P:onetype | C:typebody | B:tuple | 'void' | 'import' P:args ( '.' word )* targs?
onetype : type
typeindex : type?
tuple : ( titem ( ',' titem )* ','? )?
titem : '...'? ( id '?'? ':' )? type '?'?
targs : '<' type ( ',' type )* '>'
tparams : '<' tparam ( ',' tparam )* ','? '>'
tparam : ( 'const' | 'in' )? id ( 'extends' type )? ( '=' type )?
tmembers : tmember ( ',' tmember )* ','? | nothing
tmember : ( '-' | '+' )? 'readonly'? ( key '?'? ( ':' type )? | ( 'get' | 'set' )? key '?'? TPARAMS P:params ( ':' rettype )? | TPARAMS P:params ( ':' rettype )?
  | 'new' TPARAMS P:params ( ':' type )? | B:mapped ( ( '-' | '+' )? '?' )? ( ':' type )? )
mapped : id ':' type | id 'in' type ( 'as' type )?
enum : ( ( id | 's' | word ) ( '=' assign )? ( ',' ( id | 's' | word ) ( '=' assign )? )* ','? )?
id : 'type' | 'interface' | 'declare' | 'abstract' | 'namespace' | 'module' | 'global' | 'enum' | 'is' | 'asserts' | 'keyof' | 'readonly' | 'unique' | 'infer' | 'public' | 'private'
  | 'protected' | 'override' | 'satisfies' | 'implements' | 'accessor' | 'this'
deco : '@' call
annotation : ':' rettype
"""

_SLOTS = {
    "js": {
        "ANN": "", "CLOSED": "", "OPEN": "", "TPARAMS": "", "DECOS": "", "TARGS": "", "IMPLEMENTS": "", "AS": "", "PRIM": "", "SUFFIX": "", "PMODS": "", "OPT": "", "MODS": "",
        "ACCESS": "", "FIELDMARK": "", "MEMBER": "", "EXPORT": "", "TYPEONLY": "", "IMPORT": "", "IDS": "", "LHS": "",
        "VARDECL": "( 'var' | 'let' | 'using' ) decl ( ',' decl )* | 'const' set ( ',' set )*\ndecl : id | set\nset : target '=' assign",
    },
    "ts": {
        "ANN": "annotation?", "CLOSED": "", "OPEN": "", "TPARAMS": "tparams?", "DECOS": "( deco )*", "TARGS": "targs?", "IMPLEMENTS": "( 'implements' type ( ',' type )* )?",
        "AS": "( ( 'as' | 'satisfies' ) ( type | 'const' ) )*", "PRIM": "| '<' ( type | 'const' ) '>' un", "SUFFIX": "| '!' | targs", "PMODS": "( deco )* ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )*",
        "OPT": "'?'?", "MODS": "( deco )* ( 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' )*",
        "ACCESS": "( 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor' )*", "FIELDMARK": "( '?' | '!' )?",
        "MEMBER": "| MODS 'static'? ( 'async' | 'get' | 'set' )? '*'? key '?'? tparams? P:params annotation? | MODS 'static'? 'readonly'? B:mapped annotation",
        "EXPORT": "| '=' assign | simple | 'type' C:exports ( 'from' 's' )? | 'type' '*' ( 'as' id )? 'from' 's' | 'as' 'namespace' id", "TYPEONLY": "'type'?", "IMPORT": "| 'import' 'type'? id '=' expr", "IDS": "", "LHS": "| call '!'",
        "VARDECL": "( 'var' | 'let' | 'const' | 'using' ) decl ( ',' decl )*\ndecl : target ANN ( '=' assign )?",
    },
}


def _javascript(kind: str) -> str:
    text = _JS
    for _ in range(2):
        for slot, filled in _SLOTS[kind].items():
            text = "".join(filled if part == slot else part for part in _split_words(text, slot))
    more = _TS_MORE if kind == "ts" else ""
    for slot, filled in _SLOTS[kind].items():
        more = "".join(filled if part == slot else part for part in _split_words(more, slot))
    words = " | ".join(f"'{w}'" for w in _JS_RESERVED.split())
    return f"{text}{more}word : id | {words}\n"


def _split_words(text: str, slot: str) -> list[str]:
    import re

    return re.split(rf"\b({slot})\b", text)


_JS_LISTS = {
    ("C", "block"): (("unit",), ("unit",)),
    ("C", "switch"): (("swfirst",), ("swunit",)),
    ("C", "class"): (("member",), ("member",)),
    ("", "file"): (("unit", "import", "export"), ("unit", "import", "export")),
}
_TS_LISTS = _JS_LISTS | {("C", "typebody"): (("tmembers",), ("tmembers",)), ("C", "block"): (("unit", "import", "export"), ("unit", "import", "export"))}

RUST = """
%BOP = + / % == != <= >= ^ << && &
%ASG = += -= *= /= %= ^= &= |= <<= >>=
unit : ( closed )* stmt
iunit : ( attr* vis? closeditem | attr* path '!' 'i'? C:any )* ( nothing | item | attr* path '!' ( P:any | B:any ) )
stmt : nothing | let | item | expr
nothing :
attr : '#' '!'? B:any
let : attr* 'let' pat ( ':' type )? ( '=' expr ( 'else' C:block )? )?
closed : attr* ( blocklike | vis? closeditem | path '!' 'i'? C:any )
item : attr* vis? ( closeditem | openitem ) | attr
vis : 'pub' P:any?
closeditem : 'mod' 'i' C:items | fn C:block | 'struct' 'i' tparams? where? C:fields | 'union' 'i' tparams? C:fields | 'enum' 'i' tparams? where? C:variants
  | 'unsafe'? 'trait' 'i' tparams? ( ':' bounds )? where? C:items | 'unsafe'? 'impl' tparams? '!'? type ( 'for' type )? where? C:items
  | 'unsafe'? 'extern' 's'? C:items | 'i' '!' 'i' C:any
openitem : 'use' usetree | 'mod' 'i' | fn | 'struct' 'i' tparams? ( P:tfields where? | where )? | 'type' 'i' tparams? ( ':' bounds )? where? ( '=' type )? where?
  | ( 'const' | 'static' ) 'mut'? ( 'i' | '_' ) ':' type ( '=' expr )? | 'extern' 'i' name ( 'as' ( 'i' | '_' ) )?
fn : ( 'const' | 'async' | 'unsafe' | 'extern' 's'? )* 'fn' 'i' tparams? P:params ( '->' type )? where?
usetree : '::'? ( name '::' )* ( name ( 'as' ( 'i' | '_' ) )? | '*' | C:usetrees )
name : 'i' | 'self'
usetrees : ( usetree ( ',' usetree )* ','? )?
where : 'where' ( ( type | 'l' ) ':' bounds? ( ',' ( type | 'l' ) ':' bounds? )* ','? )?
tparams : '<' ( tparam ( ',' tparam )* ','? )? '>'
tparam : 'l' ( ':' bounds )? | 'const' 'i' ':' type ( '=' expr )? | 'i' ( ':' bounds? )? ( '=' type )?
bounds : bound ( '+' bound )* '+'?
bound : '?'? type | 'l' | 'for' tparams type
params : ( param ( ',' param )* ','? )?
param : attr* ( pat ':' type | '&' 'l'? 'mut'? 'self' | 'mut'? 'self' ( ':' type )? | '...' )
fields : ( field ( ',' field )* ','? )?
field : attr* vis? 'i' ':' type
tfields : ( attr* vis? type ( ',' attr* vis? type )* ','? )?
variants : ( variant ( ',' variant )* ','? )?
variant : attr* 'i' ( P:tfields | C:fields )? ( '=' expr )?
type : '&' 'l'? 'mut'? type | '&&' 'l'? 'mut'? type | '*' ( 'const' | 'mut' ) type | P:types | B:arrtype | ( 'impl' | 'dyn' ) bounds
  | ( 'unsafe' | 'extern' 's'? )* 'fn' P:fntypes ( '->' type )? | '!' | '_' | tpath | 'for' tparams type | path '!' P:any
types : ( type ( ',' type )* ','? )? | bounds
fntypes : ( ( ( 'i' | '_' ) ':' )? type ( ',' ( ( 'i' | '_' ) ':' )? type )* ','? )?
arrtype : type ( ';' expr )?
tpath : ( '::' | '<' type ( 'as' type )? '>' '::' )? tseg ( '::' tseg )*
tseg : name ( '::'? targs | P:types ( '->' type )? )?
targs : '<' ( targ ( ',' targ )* ','? )? '>'
targ : type | 'l' | 'n' | 's' | C:block | 'i' targs? ( '=' type | ':' bounds )
pat : '|'? pat1 ( '|' pat1 )*
pat1 : ( 'ref' )? 'mut'? 'i' ( '@' pat1 )? | path ( P:pats | C:fpats )? | lit | P:pats | B:pats | '&' 'mut'? pat1 | '&&' pat1 | '_' | '..' | path '!' P:any
  | ( lit | path ) ( '..=' | '..' ) ( lit | path )? | '..=' lit
lit : '-'? 'n' | 's'
pats : ( pat ( ',' pat )* ','? )?
fpats : ( fpat ( ',' fpat )* ','? )?
fpat : attr* ( 'ref'? 'mut'? 'i' ( ':' pat )? | 'n' ':' pat | '..' )
path : ( '::' | '<' type ( 'as' type )? '>' '::' )? name ( '::' ( 'i' | targs ) )*
expr : bin ( ( %ASG | '=' | '>' '>=' ) expr )? | jump
jump : 'return' expr? | 'break' 'l'? expr? | 'continue' 'l'?
bin : range ( op range )*
range : un | un? ( '..' | '..=' ) un?
op : %BOP | '-' | '*' | '|' | '||' | '<' | '>' | '>' '>'
un : ( '-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'i' ( 'const' | 'mut' ) )* post ( 'as' type )*
post : prim ( '.' ( 'i' | 'n' | 'await' ) ( '::' targs )? | P:args | B:expr | '?' )*
prim : path ( '!' ( P:any | B:any | C:any ) | C:slit )? | 'n' | 's' | P:args | B:array | blocklike | closure | jump
closure : 'static'? 'async'? 'move'? ( '||' | '|' ( cparam ( ',' cparam )* ','? )? '|' ) ( '->' type )? expr
cparam : pat1 ( ':' type )?
args : ( attr* expr ( ',' attr* expr )* ','? )?
array : args | expr ';' expr
slit : ( sfield ( ',' sfield )* ','? )? | ( sfield ',' )* '..' expr
sfield : attr* ( ( 'i' | 'n' ) ':' expr | 'i' )
blocklike : ( 'unsafe' | 'async' 'move'? | 'const' )? C:block | ( 'l' ':' )? ( 'loop' C:block | 'while' cond C:block | 'for' pat 'in' expr C:block | C:block ) | if | 'match' expr C:arms
if : 'if' cond C:block ( 'else' ( if | C:block ) )?
cond : condpart ( '&&' condpart )*
condpart : expr | 'let' pat '=' expr
arms : attr* ( armhead ( expr ',' | blocklike ','? ) )* ( armhead expr )?
armhead : attr* pat ( 'if' cond )? '=>'
"""
RUST_LISTS = {
    ("C", "block"): (("unit",), ("unit",)),
    ("C", "items"): (("iunit",), ("iunit",)),
    ("", "file"): (("iunit",), ("iunit",)),
}

PYTHON = """
%BOP = / // % @ << >> & | ^ == != <= >= < > and or + is
%ASG = += -= *= /= //= %= @= &= |= ^= >>= <<= **=
simple : small ( ';' small )* ';'?
small : exprs | ( targets '=' )+ rhs | ( target | P:single ) ':' expr ( '=' rhs )? | ( target | P:single ) %ASG rhs | 'return' exprs? | 'raise' ( expr ( 'from' expr )? )? | 'pass' | 'break' | 'continue'
  | 'import' dotted ( 'as' id )? ( ',' dotted ( 'as' id )? )* | 'from' ( '.' | '...' )* dotted? 'import' ( '*' | names | P:names ) | ( 'global' | 'nonlocal' ) id ( ',' id )*
  | 'assert' expr ( ',' expr )? | 'del' targets | 'type' id B:tparams? '=' expr | yield
names : id ( 'as' id )? ( ',' id ( 'as' id )? )* ','?
dotted : id ( '.' id )*
rhs : exprs | yield
yield : 'yield' ( 'from' expr | exprs )?
header : hdr ':' simple?
hdr : 'async'? 'for' targets 'in' exprs | 'while' nexpr | 'if' nexpr | 'elif' nexpr | 'else' | 'try' | 'except' '*'? ( expr ( ',' expr )* ( 'as' id )? )? | 'finally' | 'async'? 'with' ( witems | P:witems )
  | 'async'? 'def' id B:tparams? P:params ( '->' expr )? | 'class' id B:tparams? P:args? | 'match' nexprs | 'case' pats ( 'if' nexpr )?
witems : nexpr ( 'as' goal )? ( ',' nexpr ( 'as' goal )? )* ','?
targets : ( '*'? goal ) ( ',' '*'? goal )* ','?
goal : target | P:goals | B:goals
goals : targets?
single : target | P:single
target : id | prim ( B:sub | '.' id )
pats : pat ( ',' pat )* ','?
pat : por ( 'as' id )?
por : patom ( '|' patom )*
patom : 'True' | 'False' | 'None' | '-'? 'n' ( ( '+' | '-' ) 'n' )? | 's'+ | dotted P:pargs? | P:pseq | B:pseq | C:pmap | '*' id
pargs : ( ( id '=' )? pat ( ',' ( id '=' )? pat )* ','? )?
pseq : pats?
pmap : ( pitem ( ',' pitem )* ','? )?
pitem : patom ':' pat | '**' id
decorator : '@' nexpr
exprs : star ( ',' star )* ','?
star : '*' bin | expr
expr : tern
nexpr : ( id ':=' )? tern
nstar : '*' bin | nexpr
nexprs : nstar ( ',' nstar )* ','?
tern : bin ( 'if' bin 'else' tern )? | 'lambda' lparams ':' expr
bin : un ( ( %BOP | '-' | '*' | '**' | '+' | 'in' | 'not' 'in' | 'is' 'not' ) un )*
un : ( 'not' | '-' | '+' | '~' | 'await' )* prim
prim : atom ( P:args | B:sub | '.' id )*
atom : id | 'True' | 'False' | 'None' | 'n' | 's'+ | P:tuple | B:list | C:dict | '...'
tuple : nexprs? | nexpr comp | yield
list : nexprs? | nexpr comp
dict : ( ditem ( ',' ditem )* ','? )? | nexprs | nexpr comp | expr ':' expr comp
ditem : expr ':' expr | '**' bin
comp : ( 'async'? 'for' targets 'in' source cond* )+
source : bin | bin 'if' bin 'else' bin | 'lambda' lparams ':' bin
cond : 'if' bin | 'if' id ':=' bin | 'if' 'lambda' lparams ':' expr
args : ( ( plain ( ',' keyed )? | keyed ) ','? )? | nexpr comp
plain : ( nexpr | '*' expr ) ( ',' ( nexpr | '*' expr ) )*
keyed : ( id '=' expr ( ',' ( id '=' expr | '*' expr ) )* ( ',' mapped )? ) | mapped
mapped : '**' expr ( ',' ( '**' expr | id '=' expr ) )*
sub : slice ( ',' slice )* ','?
slice : nstar | expr? ':' expr? ( ':' expr? )?
params : ( ( ahead ( ',' rest )? | rest ) ','? )?
ahead : p ( ',' p )* ( ',' '/' ( ',' p )* )? ( ',' d ( ',' d )* ( ',' '/' ( ',' d )* )? )? | d ( ',' d )* ( ',' '/' ( ',' d )* )?
rest : ( '*' id ( ':' star )? | '*' ',' ( p | d ) ) ( ',' ( p | d ) )* ( ',' '**' p )? | '**' p
p : id ( ':' expr )?
d : p '=' expr
lparams : ( ( lahead ( ',' lrest )? | lrest ) ','? )?
lahead : id ( ',' id )* ( ',' '/' ( ',' id )* )? ( ',' ld ( ',' ld )* ( ',' '/' ( ',' ld )* )? )? | ld ( ',' ld )* ( ',' '/' ( ',' ld )* )?
lrest : ( '*' id | '*' ',' ( id | ld ) ) ( ',' ( id | ld ) )* ( ',' '**' id )? | '**' id
ld : id '=' expr
field : ( nexprs | yield ) '='?
tparams : tparam ( ',' tparam )* ','?
tparam : ( '*' | '**' )? id ( ':' expr )? ( '=' star )?
id : 'i' | 'match' | 'case' | 'type'
"""
PYTHON_LISTS: dict = {}

TEXTS = {
    "go": (GO, GO_LISTS),
    "js": (_javascript("js"), _JS_LISTS),
    "ts": (_javascript("ts"), _TS_LISTS),
    "rs": (RUST, RUST_LISTS),
    "py": (PYTHON, PYTHON_LISTS),
}
