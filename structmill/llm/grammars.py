"""Local grammars of the languages, in the notation of :mod:`structmill.llm.notation`."""

from __future__ import annotations

from functools import lru_cache

from structmill.llm.notation import Grammar
from structmill.llm.vocabulary import WORDS

# JavaScript and TypeScript ------------------------------------------------------------------------------------

_SCRIPT = """
never : 'NEVER'
name : ID | SOFT
word : ID | WORDS | STR
key : ID | WORDS | STR | NUM | A.SEQ
sep : ';' | NL
end : sep+ | $
file : sep* ( stmt sep* )*
b_block : sep* ( stmt sep* )*
seq : expr ( ',' expr )*
hole : ( '...'? seq )?
expr : unit ( binop unit )* ( '?' expr ':' expr )?
binop : '>'+ '='? | BIN
unit : pre* prim post* | 'yield'
pre : PRE | 'yield' '*'?
prim : arrow | fn | cls | 'new' ( '.' ID | unit ) | 'import' ( P.ARGS | '.' ID ) | name | CONSTANT | NUM | STR | TPL | P.SEQ | A.ARR | B.OBJ | generics unit
arrow : 'async'? ( generics? P.PARAMS ret? | name ) '=>' ( B.BLOCK | !( B.OBJ ) expr )
fn : 'async'? 'function' '*'? name? generics? P.PARAMS ret? NL? B.BLOCK
cls : deco* 'class' name? generics? ( 'extends' unit generics? )? ( 'implements' type ( ',' type )* )? NL? B.CLASS
deco : '@' ( name ( '.' ID )* P.ARGS? | P.SEQ ) NL?
post : '.' ID | '?.' ( ID | P.ARGS | A.SEQ ) | P.ARGS | A.SEQ | TPL | '++' | '--' | bang | generics P.ARGS | cast
stmt : B.BLOCK | typed | fn | cls
  | VARS bind ( ',' bind )* end
  | 'if' P.SEQ NL? stmt ( sep* 'else' stmt )?
  | 'for' 'await'? P.FOR NL? stmt
  | 'while' P.SEQ NL? stmt
  | 'do' stmt sep* 'while' P.SEQ
  | 'try' B.BLOCK ( NL* 'catch' P.PARAMS? NL? B.BLOCK ( NL* 'finally' B.BLOCK )? | NL* 'finally' B.BLOCK )
  | 'switch' P.SEQ NL? B.SWITCH
  | 'return' seq? end | 'throw' seq end | JUMP name? end | 'debugger' end
  | 'import' typeword? ( STR | imported 'from' STR ) ( 'with' B.OBJ )? end
  | 'export' exported
  | name ':' NL? stmt
  | !( B.OBJ ) seq end
  | ';'
imported : '*' 'as' name | B.IMPORTS | name ( ',' ( B.IMPORTS | '*' 'as' name ) )?
exported : 'default' ( fn | cls | typed | expr end ) | '*' ( 'as' word )? 'from' STR end | typeword? B.IMPORTS ( 'from' STR )? end | '=' expr end | stmt
b_imports : ( spec ( ',' spec )* ','? )?
spec : typeword word ( 'as' word )? | word ( 'as' word )?
bind : target bang? ( ':' type )? ( '=' expr )?
target : name | B.OBJ | A.ARR
p_seq : seq
p_args : ( '...'? expr ( ',' '...'? expr )* ','? )?
p_params : ( par ( ',' par )* ','? )?
par : deco* modword* '...'? ( target | 'this' ) ( optional )? ( ':' type )? ( '=' expr )?
p_for : ( VARS bind ( ',' bind )* | seq )? ';' seq? ';' seq? | VARS? ( target | unit ) ( 'of' | 'in' ) seq
a_seq : seq
a_arr : ','* ( '...'? expr ( ','+ '...'? expr )* )? ','*
b_obj : ( prop ( ',' prop )* ','? )?
prop : '...' expr | method | key ':' expr | name ( '=' expr )?
method : ACCESS '*'? key P.PARAMS ret? B.BLOCK | 'async' '*'? key generics? P.PARAMS ret? B.BLOCK | '*'? key generics? P.PARAMS ret? B.BLOCK
b_switch : sep* ( ( 'case' seq ':' | 'default' ':' ) sep* ( stmt sep* )* )*
b_class : sep* ( member sep* )*
member : 'static' B.BLOCK | deco* modifier* ( ACCESS key P.PARAMS ret? body | 'async' '*'? key generics? P.PARAMS ret? body
  | '*'? key optional? generics? P.PARAMS ret? body | indexed | key ( optional | bang )? ( ':' type )? ( '=' expr )? end )
modifier : MODS !( '=' | ';' | ':' | '?' | P.PARAMS | NL | $ )
"""
_TYPES = """
ret : ':' type
bang : '!'
optional : '?'
cast : ( 'as' | 'satisfies' ) ( 'const' | type )
typeword : 'type'
modword : PARMODS
body : NL? B.BLOCK | end
indexed : A.INDEX ':' type end
generics : '<' tpar ( ',' tpar )* ','? '>'
tpar : 'const'? type ( 'extends' type )? ( '=' type )?
type : ( '|' | '&' )? tun ( ( '|' | '&' ) tun )* ( 'extends' type '?' type ':' type )?
tun : tpre* tp ( A.EMPTY | A.TYPE )*
tpre : TPRE !( ',' | '>' | ')' | ';' | '=' | NL | $ )
tp : 'new'? generics? P.PARAMS '=>' type | 'import' P.ARGS ( '.' ID )* generics? | ( name | 'this' ) 'is' type | 'typeof' name ( '.' ID )* generics?
  | TCONST | name ( '.' ID )* generics? | STR | TPL | '-'? NUM | B.TBODY | A.TUPLE | P.TYPE
p_type : type
a_empty : $
a_type : type
a_index : name ':' type
a_mapped : name 'in' type ( 'as' type )?
a_tuple : ( telem ( ',' telem )* ','? )?
telem : '...'? ( name '?'? ':' type | type '?'? )
b_tbody : sep* ( tmem tsep* )*
tsep : ';' | ',' | NL
tend : tsep+ | $
tmem : ( ( '+' | '-' )? 'readonly' )? A.MAPPED ( ( '+' | '-' )? '?' )? ':' type tend | 'readonly'? A.INDEX ':' type tend | ACCESS key P.PARAMS ret? tend | 'new'? generics? P.PARAMS ret? tend
  | 'readonly'? key '?'? ( generics? P.PARAMS ret? | ':' type )? tend
b_enum : ( key ( '=' expr )? ( ',' key ( '=' expr )? )* ','? )?
typed : 'declare'? ( 'interface' name generics? ( 'extends' type ( ',' type )* )? NL? B.TBODY | 'type' name generics? '=' type end | 'const'? 'enum' name NL? B.ENUM
  | ( 'namespace' | 'module' ) ( name ( '.' ID )* | STR ) NL? B.BLOCK | 'abstract' cls ) | 'async'? 'function' name generics? P.PARAMS ret? end | 'declare' !( '=' | '.' | P.ARGS ) stmt
"""
_NO_TYPES = "\n".join(f"{r} : never" for r in "ret bang optional cast typeword modword indexed generics type typed".split()) + "\nbody : NL? B.BLOCK"

_SCRIPT_CLASSES = {
    "BIN": "+ - * / % ** << & | ^ && || ?? < <= == != === !== in instanceof = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=",
    "PRE": "! ~ + - ++ -- typeof void delete await",
    "CONSTANT": "this super null true false",
    "VARS": "var let const",
    "JUMP": "break continue",
    "ACCESS": "get set",
}
_SCRIPT_SOFT = "of from as async get set let static"
_TYPE_SOFT = "type interface namespace module declare abstract readonly public private protected keyof is satisfies override infer unique asserts implements"


def _script(typed: bool) -> Grammar:
    language = "typescript" if typed else "javascript"
    classes = _SCRIPT_CLASSES | {"TPL": "TPL", "WORDS": " ".join(sorted(WORDS[language])), "SOFT": _SCRIPT_SOFT + (" " + _TYPE_SOFT if typed else "")}
    classes["MODS"] = "static" + (" public private protected readonly abstract override declare async" if typed else "")
    classes |= {"PARMODS": "public private protected readonly override", "TPRE": "keyof readonly unique infer asserts", "TCONST": "this void null true false"} if typed else {}
    kinds = {"P": "seq args params for", "A": "seq arr", "B": "block~ obj class~ imports switch~"}
    if typed:
        kinds = {"P": kinds["P"] + " type", "A": kinds["A"] + " empty type index mapped tuple", "B": kinds["B"] + " tbody~ enum"}
        classes["MODS"] = classes["MODS"].replace(" async", "")
    return Grammar(_SCRIPT + (_TYPES if typed else _NO_TYPES), kinds, "file", classes)


# Go -----------------------------------------------------------------------------------------------------------

_GO = """
sep : ';' | NL
end : sep+ | $
file : sep* 'package' ID end ( 'import' ( impspec | P.IMPORTS ) end )* ( decl end )*
impspec : ( ID | '.' )? STR
p_imports : sep* ( impspec end )*
decl : 'const' ( cspec | P.CONSTS ) | 'var' ( vspec | P.VARS ) | 'type' ( tspec | P.TYPES ) | 'func' ( P.PARAMS )? ID A.TPARAMS? P.PARAMS result? B.BLOCK?
ids : ID ( ',' ID )*
cspec : ids type? ( '=' exprs )?
vspec : ids ( '=' exprs | type ( '=' exprs )? )
tspec : ID A.TPARAMS '='? type | ID '='? type
p_consts : sep* ( cspec end )*
p_vars : sep* ( vspec end )*
p_types : sep* ( tspec end )*
type : '*' type | 'chan' '<-'? type | '<-' 'chan' type | 'map' A.TYPES type | 'func' P.PARAMS result? | 'struct' B.STRUCT | 'interface' B.IFACE | A.EMPTY type | A.SIZE type | ID ( '.' ID )? A.TYPES? | P.TYPE
result : P.PARAMS | type
p_type : type
p_params : ( par ( ',' par )* ','? )?
par : ID '...'? type | '...'? type
con : '~'? type ( '|' '~'? type )*
a_tparams : ids con ( ',' ids con )* ','?
a_empty : $
a_size : expr | '...'
a_types : type ( ',' type )* ','?
a_index : expr ( ':' expr? )* | ( ':' expr? )+
exprs : expr ( ',' expr )*
expr : unit ( binop unit )*
binop : '>' '>'? | BIN
unit : PRE* prim ( post | B.LIT )*
prim : NUM | STR | 'func' P.PARAMS result? B.BLOCK | 'struct' B.STRUCT B.LIT | 'interface' B.IFACE P.ARGS | ( A.EMPTY | A.SIZE | 'map' A.TYPES ) type ( B.LIT | P.ARGS ) | 'chan' type P.ARGS | ID | P.PAREN
post : '.' ( ID | P.ASSERT ) | P.ARGS | A.INDEX | A.TYPES
p_paren : expr | type
p_assert : type | 'type'
p_args : ( arg ( ',' arg )* '...'? ','? )?
arg : expr !( ID ) | type
h_exprs : h_expr ( ',' h_expr )*
h_expr : h_unit ( binop h_unit )*
h_unit : PRE* prim post*
assign : ':=' | '>' '>=' | ASSIGN
simple : exprs ( assign 'range'? exprs | '++' | '--' | '<-' expr )?
h_simple : h_exprs ( assign 'range'? h_exprs | '++' | '--' | '<-' h_expr )?
stmt : B.BLOCK | decl | 'return' exprs? | 'if' if_rest | 'for' for_head? B.BLOCK | 'switch' ( h_simple? ';' )? h_simple? B.SWITCH | 'select' B.SWITCH
  | ( 'go' | 'defer' ) expr | JUMP ID? | 'fallthrough' | ID ':' sep* stmt? | simple
if_rest : ( h_simple? ';' )? h_expr B.BLOCK ( 'else' ( 'if' if_rest | B.BLOCK ) )?
for_head : h_simple? ';' h_expr? ';' h_simple? | 'range' h_expr | h_simple
b_block : sep* ( stmt end )*
b_switch : sep* ( ( 'case' cases | 'default' ) ':' sep* ( stmt end )* )*
cases : simple !( ',' ) | casex ( ',' casex )*
casex : expr !( ID ) | type
b_lit : ( elem ( ',' elem )* ','? )?
elem : ( expr | B.LIT ) ( ':' ( expr | B.LIT ) )?
b_struct : sep* ( ( ids type | '*'? ID ( '.' ID )? A.TYPES? ) STR? end )*
b_iface : sep* ( ( ID P.PARAMS result? | con ) end )*
"""


def _go() -> Grammar:
    kinds = {"P": "imports~ consts~ vars~ types~ type~ params~ paren~ assert~ args~", "A": "tparams~ empty~ size~ types~ index~", "B": "block~ switch~ lit~ struct~ iface~"}
    classes = {
        "BIN": "+ - * / % & | ^ << &^ && || == < <= >= !=",
        "PRE": "+ - ! ^ * & <-",
        "ASSIGN": "= += -= *= /= %= &= |= ^= <<= &^=",
        "JUMP": "break continue goto",
    }
    return Grammar(_GO, kinds, "file", classes)


# Java ---------------------------------------------------------------------------------------------------------

_JAVA = """
name : ID | SOFT
qname : name ( '.' name )*
file : ( anno* 'package' qname ';' )? ( 'import' 'static'? qname ( '.' '*' )? ';' | ';' )* ( tdecl | ';' )*
anno : '@' qname P.ANNO?
mods : ( MODS | anno | ID '-' 'sealed' )*
types : type ( ',' type )*
tdecl : mods ( 'class' name tparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? B.CLASS | 'interface' name tparams? ( 'extends' types )? ( 'permits' types )? B.CLASS
  | 'enum' name ( 'implements' types )? B.ENUM | 'record' name tparams? P.PARAMS ( 'implements' types )? B.CLASS | '@' 'interface' name B.CLASS )
type : anno* ( PRIM | name targs? ( '.' name targs? )* ) dim*
dim : anno* A.EMPTY
targs : '<' ( targ ( ',' targ )* )? '>'
targ : anno* '?' ( ( 'extends' | 'super' ) type )? | type
tparams : '<' tpar ( ',' tpar )* '>'
tpar : anno* name ( 'extends' type ( '&' type )* )?
member : ';' | 'static'? B.BLOCK | tdecl | mods tparams? ( 'void' | type ) name P.PARAMS dim* throws? ( B.BLOCK | 'default' ( anno | B.ARRAY | expr ) ';' | ';' )
  | mods tparams? name P.PARAMS throws? B.BLOCK | mods name B.BLOCK | mods type vars ';'
throws : 'throws' types
vars : var ( ',' var )*
var : name dim* ( '=' ( expr | B.ARRAY ) )?
b_class : member*
b_enum : ( econst ( ',' econst )* ','? )? ( ';' member* )?
econst : anno* name P.ARGS? B.CLASS?
p_params : ( par ( ',' par )* )?
par : mods type ( anno* '...' )? ( name '.' )? ( name | 'this' ) dim*
b_block : stmt*
stmt : B.BLOCK | ';' | 'if' P.EXPR stmt ( 'else' stmt )? | 'for' P.FOR stmt | 'while' P.EXPR stmt | 'do' stmt 'while' P.EXPR ';'
  | 'try' ( P.RES B.BLOCK catch* finally? | B.BLOCK ( catch+ finally? | finally ) ) | 'switch' P.EXPR B.SWITCH | 'return' expr? ';' | 'throw' expr ';' | JUMP name? ';'
  | 'assert' expr ( ':' expr )? ';' | 'synchronized' P.EXPR B.BLOCK | tdecl | mods type vars ';' | name ':' stmt | 'yield' expr ';' | expr ';'
catch : 'catch' P.CATCH B.BLOCK
finally : 'finally' B.BLOCK
p_for : ( mods type vars | exprs )? ';' expr? ';' exprs? | mods type name ':' expr
p_res : res ( ';' res )* ';'?
res : mods type name '=' expr | expr
p_catch : mods type ( '|' type )* name
b_switch : ( label stmt* )+ | arm*
label : ( 'case' cases ( 'when' expr )? | 'default' ) ':'
arm : ( 'case' cases ( 'when' cexpr )? | 'default' ) '->' ( B.BLOCK | 'throw' expr ';' | expr ';' )
cases : casex ( ',' casex )*
casex : 'default' | pattern | cexpr ( '?' expr ':' expr )?
pattern : mods type P.PATTERN name? | mods type name !( '.' | P.ARGS )
p_pattern : ( pattern ( ',' pattern )* )?
exprs : expr ( ',' expr )*
expr : lambda | cexpr ( ASSIGN expr | '?' expr ':' expr )?
lambda : ( name | P.LAMBDA ) '->' ( B.BLOCK | expr )
p_lambda : ( ( par | name ) ( ',' ( par | name ) )* )?
cexpr : unit ( binop unit | 'instanceof' ( pattern | mods type ) )*
binop : '>'+ '='? | BIN
unit : PRE* P.CAST ( lambda | unit ) | PRE* prim post*
prim : 'switch' P.EXPR B.SWITCH | 'new' created | CONSTANT | NUM | STR | P.EXPR | 'void' '.' 'class' | PRIM dim* ( '.' 'class' | '::' 'new' ) | name targs ( '.' name targs? )* dim* '::' ( name | 'new' ) | name
created : anno* ( PRIM | name targs? ( '.' name targs? )* ) ( P.ARGS B.CLASS? | A.EXPR+ A.EMPTY* | A.EMPTY+ B.ARRAY )
post : '.' ( name | 'class' | 'this' | 'super' | 'new' created | targs name ) | P.ARGS | A.EXPR | '++' | '--' | '::' ( name | 'new' ) | A.EMPTY+ ( '.' 'class' | '::' 'new' )
p_args : exprs?
p_expr : expr
p_cast : type ( '&' type )*
p_anno : ( name '=' value ( ',' name '=' value )* | value )?
value : anno | B.ARRAY | expr
b_array : ( value ( ',' value )* ','? )?
a_expr : expr
a_empty : $
"""


def _java() -> Grammar:
    kinds = {"P": "expr args params for res catch anno lambda cast pattern", "A": "expr empty", "B": "block class enum switch array"}
    classes = {
        "SOFT": "record sealed permits yield when",
        "MODS": "public private protected static final abstract native synchronized transient volatile strictfp default sealed",
        "PRIM": "boolean byte char double float int long short",
        "BIN": "< == <= != && || + - * / & | ^ % <<",
        "ASSIGN": "= += -= *= /= &= |= ^= %= <<=",
        "PRE": "+ - ! ~ ++ --",
        "CONSTANT": "true false null this super",
        "JUMP": "break continue",
    }
    return Grammar(_JAVA, kinds, "file", classes)


# Rust ---------------------------------------------------------------------------------------------------------

_RUST = """
attr : '#' '!'? A.TREE
vis : 'pub' P.TREE?
w : ID | SELF
file : item* attr*
b_items : item* attr*
item : attr* vis? ( fnitem | 'struct' ID tparams? ( where? B.FIELDS | P.FIELDS where? ';' | ';' ) | 'enum' ID tparams? where? B.VARIANTS | 'union' ID tparams? where? B.FIELDS
  | 'unsafe'? 'impl' tparams? ( '!'? type 'for' )? type where? B.ITEMS | 'unsafe'? 'trait' ID tparams? ( ':' bounds? )? where? B.ITEMS | 'mod' ID ( B.ITEMS | ';' ) | 'use' use ';'
  | 'const' ID ':' type ( '=' expr )? ';' | 'static' 'mut'? ID ':' type ( '=' expr )? ';' | 'type' ID tparams? ( ':' bounds )? where? ( '=' type )? where? ';'
  | 'extern' 'crate' w ( 'as' ID )? ';' | 'unsafe'? 'extern' STR? B.ITEMS | path '!' ID? ( B.TREE | ( P.TREE | A.TREE ) ';' ) )
use : '::'? ( w '::' )* ( '*' | B.USES | w ( 'as' ID )? )
b_uses : ( use ( ',' use )* ','? )?
fnitem : ( 'const' | 'async' | 'unsafe' | 'extern' STR? )* 'fn' ID tparams? P.PARAMS ( '->' type )? where? ( B.BLOCK | ';' )
tparams : '<' ( tpar ( ',' tpar )* ','? )? '>'
tpar : attr* ( STR ( ':' bounds? )? | 'const' ID ':' type ( '=' ( B.BLOCK | unit ) )? | ID ( ':' bounds? )? ( '=' type )? )
bounds : bound ( '+' bound )* '+'?
bound : STR | '?'? ( 'for' tparams )? tpath | P.TREE | '~'? 'const' bound
where : 'where' ( clause ( ',' clause )* ','? )?
clause : ( 'for' tparams )? ( STR | type ) ':' bounds?
type : ( '&' | '&&' ) STR? 'mut'? type | '*' ( 'const' | 'mut' ) type | '!' | ( 'impl' | 'dyn' ) bounds | ( 'for' tparams )? ( 'unsafe' | 'extern' STR? )* 'fn' P.PARAMS ( '->' type )?
  | '<' type ( 'as' type )? '>' ( '::' ID targs? )+ | tpath ( '!' ( P.TREE | A.TREE | B.TREE ) )? | P.TYPES | A.TYPE
tpath : '::'? tseg ( '::' tseg )*
tseg : w ( '::'? targs | P.TYPES ( '->' type )? )?
targs : '<' ( targ ( ',' targ )* ','? )? '>'
targ : STR | ID targs? '=' type | ID ':' bounds | type | '-'? NUM | B.BLOCK
p_params : ( par ( ',' par )* ','? )?
par : attr* ( '&' STR? 'mut'? 'self' | 'mut'? 'self' ( ':' type )? | '...' | pat1 ':' ( type | '...' ) | type )
p_types : ( type ( ',' type )* ','? )?
p_fields : ( attr* vis? type ( ',' attr* vis? type )* ','? )?
b_fields : ( attr* vis? ID ':' type ( ',' attr* vis? ID ':' type )* ','? )?
b_variants : ( variant ( ',' variant )* ','? )?
variant : attr* vis? ID ( P.FIELDS | B.FIELDS )? ( '=' expr )?
a_type : type ( ';' expr )?
p_tree : ANY*
a_tree : ANY*
b_tree : ANY*
path : '::'? w ( '::' ( w | targs ) )* | '<' type ( 'as' type )? '>' ( '::' ( w | targs ) )+
expr : range expr0? | expr0 ( range expr0? )?
expr0 : unit ( binop unit | 'as' type )*
range : '..' | '..='
binop : '>'+ '='? | BIN
unit : pre* prim post*
pre : '&' 'mut'? | '&&' 'mut'? | PRE
prim : NUM | STR !( ':' ) | CONSTANT | closure | blocky | 'return' expr? | 'break' STR? expr? | 'continue' STR? | path ( '!' ( P.TREE | A.TREE | B.TREE ) | B.LIT )? | P.ARGS | A.ARRAY
post : '.' ( ID ( '::' targs )? | NUM | 'await' ) | P.ARGS | A.INDEX | '?'
h_expr : range h_expr0? | h_expr0 ( range h_expr0? )?
h_expr0 : h_unit ( binop h_unit | 'as' type )*
h_unit : pre* h_prim post*
h_prim : NUM | STR | CONSTANT | closure | blocky | 'return' | 'break' | 'continue' | path ( '!' ( P.TREE | A.TREE | B.TREE ) )? | P.ARGS | A.ARRAY
closure : 'async'? 'move'? ( '||' | '|' ( cpar ( ',' cpar )* ','? )? '|' ) ( '->' type B.BLOCK | expr )
cpar : attr* pat1 ( ':' type )?
blocky : 'unsafe' B.BLOCK | 'async' 'move'? B.BLOCK | 'const' B.BLOCK | if | 'match' h_expr B.ARMS | ( STR ':' )? ( 'loop' B.BLOCK | 'while' cond B.BLOCK | 'for' pat 'in' h_expr B.BLOCK | B.BLOCK )
if : 'if' cond B.BLOCK ( 'else' ( if | B.BLOCK ) )?
cond : ( 'let' pat '=' )? h_expr ( '&&' 'let' pat '=' h_expr )*
b_block : attr* stmt*
stmt : ';' | item | attr* 'let' pat ( ':' type )? ( '=' expr ( 'else' B.BLOCK )? )? ';' | attr* blocky !( '.' | '?' | 'as' | '==' ) ';'? | attr* expr ( ';' | $ )
pat : '|'? pat1 ( '|' pat1 )*
pat1 : ( 'ref' | 'mut' | '&' | '&&' )* patp ( '@' pat1 )? ( ( '..=' | '...' | '..' ) patp? )?
patp : '-'? NUM | STR | CONSTANT | '..=' patp | '..' | path ( P.PATS | B.PATS | '!' P.TREE )? | P.PATS | A.PATS | 'const' B.BLOCK
p_pats : ( pat ( ',' pat )* ','? )?
a_pats : ( pat ( ',' pat )* ','? )?
b_pats : ( pfield ( ',' pfield )* ','? )?
pfield : attr* ( '..' | ( ID | NUM ) ':' pat | 'ref'? 'mut'? ID )
b_arms : arm*
arm : attr* pat ( 'if' cond )? '=>' ( blocky !( '.' | '?' | 'as' ) ','? | expr ( ',' | $ ) )
b_lit : ( lit ( ',' lit )* ','? )?
lit : attr* ( '..' expr? | ( ID | NUM ) ( ':' expr )? )
p_args : ( attr* expr ( ',' attr* expr )* ','? )?
a_array : expr ';' expr | ( expr ( ',' expr )* ','? )?
a_index : expr
"""


def _rust() -> Grammar:
    kinds = {"P": "tree params types fields pats args", "A": "tree type pats array index", "B": "tree items uses fields variants block pats arms lit"}
    classes = {
        "SELF": "self Self super crate",
        "BIN": "+ - * / % ^ & | && || << = == != < <= += -= *= /= %= ^= &= |= <<=",
        "PRE": "- ! *",
        "CONSTANT": "true false",
    }
    return Grammar(_RUST, kinds, "file", classes)


# Python -------------------------------------------------------------------------------------------------------

_PYTHON = """
name : ID | SOFT
file : stmt*
i_block : stmt+
i_cases : ( 'case' patterns ( 'if' named )? ':' suite )+
end : NL | $
stmt : compound | small ( ';' small )* ';'? end
suite : NL I.BLOCK | !( NL ) small ( ';' small )* ';'? end
small : 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' ( expr ( 'from' expr )? )? | 'assert' expr ( ',' expr )? | 'del' stars | ( 'global' | 'nonlocal' ) name ( ',' name )*
  | 'import' module ( ',' module )* | 'from' ( '.' | '...' )* dotted? 'import' ( '*' | P.NAMES | names ) | 'type' name A.TPARAMS? '=' expr | assign
module : dotted ( 'as' name )?
dotted : name ( '.' name )*
names : iname ( ',' iname )*
iname : name ( 'as' name )?
p_names : iname ( ',' iname )* ','?
assign : yielded | ( targets '=' )+ value | lhs ( ':' expr ( '=' value )? | AUG value ) | stars
value : yielded | stars
yielded : 'yield' ( 'from' expr | stars )?
targets : '*'? lhs ( ',' '*'? lhs )* ','?
lhs : atom hop+ | name | P.TARGETS | A.TARGETS
hop : P.ARGS* ( '.' name | A.INDEX )
p_targets : targets?
a_targets : targets?
stars : star ( ',' star )* ','?
star : '*' bits | named
named : name ':=' expr | expr
expr : 'lambda' lparams? ':' expr | either ( 'if' either 'else' expr )?
either : both ( ( 'or' | 'and' ) both )*
both : 'not'* bits ( ( CMP | 'not' 'in' | 'is' 'not'? | 'in' ) bits )*
bits : SIGN* 'await'? atom post* ( BIN SIGN* 'await'? atom post* )*
atom : name | NUM | STR+ | CONSTANT | P.PAREN | A.LIST | B.DICT | '...'
post : '.' name | P.ARGS | A.INDEX
p_paren : ( yielded | star ( comp+ | ( ',' star )* ','? ) )?
a_list : ( star ( comp+ | ( ',' star )* ','? ) )?
b_dict : ( pair ( comp+ | ( ',' pair )* ','? ) | star ( comp+ | ( ',' star )* ','? ) )?
pair : '**' bits | expr ':' expr
comp : 'async'? 'for' targets 'in' ( 'lambda' lparams? ':' expr | either ) ( 'if' ( name ':=' either | either ) )*
p_args : ( arg ( ',' arg )* ','? )?
arg : name '=' expr | '**' expr | '*' expr | named comp*
a_index : slice ( ',' slice )* ','?
slice : ':' expr? ( ':' expr? )? | '*' bits | named ( ':' expr? ( ':' expr? )? )?
p_params : ( par ( ',' par )* ','? )?
par : '/' | '**' name ( ':' expr )? | '*' ( name ( ':' star )? )? | name ( ':' expr )? ( '=' expr )?
lparams : lpar ( ',' lpar )* ','?
lpar : '/' | '**' name | '*' name? | name ( '=' expr )?
a_tparams : tpar ( ',' tpar )* ','?
tpar : ( '*' | '**' )? name ( ':' expr )? ( '=' star )?
compound : deco* ( 'async'? 'def' name A.TPARAMS? P.PARAMS ( '->' expr )? ':' suite | 'class' name A.TPARAMS? P.ARGS? ':' suite )
  | 'if' named ':' suite ( 'elif' named ':' suite )* else
  | 'while' named ':' suite else
  | 'async'? 'for' targets 'in' stars ':' suite else
  | 'async'? 'with' ( withs ':' | P.WITH ':' ) suite
  | 'try' ':' suite ( ( 'except' '*'? ( expr ( 'as' name )? )? ':' suite )+ else ( 'finally' ':' suite )? | 'finally' ':' suite )
  | 'match' stars ':' NL I.CASES
deco : '@' named NL
else : ( 'else' ':' suite )?
withs : with ( ',' with )* ','?
with : expr ( 'as' lhs )?
p_with : withs
patterns : pat ( ',' pat )* ','?
pat : '*' name | cpat ( '|' cpat )* ( 'as' name )?
cpat : '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | CONSTANT | name ( '.' name )* P.CPATS? | P.PATS | A.PATS | B.MPATS
p_cpats : ( cparg ( ',' cparg )* ','? )?
cparg : name '=' pat | pat
p_pats : patterns?
a_pats : patterns?
b_mpats : ( mpat ( ',' mpat )* ','? )?
mpat : '**' name | cpat ':' pat
"""


def _python() -> Grammar:
    kinds = {"P": "paren args params targets with names cpats pats", "A": "list index targets tparams pats", "B": "dict mpats", "I": "block~ cases~"}
    classes = {
        "SOFT": "match case type",
        "CONSTANT": "True False None",
        "AUG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=",
        "CMP": "< > <= >= == !=",
        "BIN": "+ - * / // % @ ** << >> & | ^",
        "SIGN": "+ - ~",
    }
    return Grammar(_PYTHON, kinds, "file", classes)


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    build = {"python": _python, "javascript": lambda: _script(False), "typescript": lambda: _script(True), "tsx": lambda: _script(True), "go": _go, "java": _java, "rust": _rust}
    return build[language]()
