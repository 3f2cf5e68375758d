"""Grammars of Python 3.13, TypeScript, JavaScript modules, Go, Rust 2021 and Java 17 for the GLL recogniser.

Only what decides whether a text is grammatical is told apart: operator precedence is flat, since it never
changes acceptance. Names, types and imports are not checked.
"""

from __future__ import annotations

import re
from functools import lru_cache

from graphlode.sources import lexing
from graphlode.llm.gll import Grammar

PYTHON = r"""
file: (NEWLINE | stmt)* END ;
stmt: simples | 'async'? funcdef | classdef | decorated | ifs | whiles | 'async'? fors | trys | 'async'? withs | matchs ;
simples: simple (';' simple)* ';'? NEWLINE ;
block: simples | NEWLINE INDENT stmt+ DEDENT ;
simple: exprs (':' e ('=' (exprs | yields))? | augmented (exprs | yields) | ('=' (exprs | yields))*) | yields | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (e ('from' e)?)?
  | ('global' | 'nonlocal') NAME (',' NAME)* | 'del' exprs | 'assert' e (',' e)? | 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)*
  | 'from' (('.' | '...')+ dotted? | dotted) 'import' ('*' | '(' NAME ('as' NAME)? (',' NAME ('as' NAME)?)* ','? ')' | NAME ('as' NAME)? (',' NAME ('as' NAME)?)*)
  | 'type' NAME typeparams? '=' e ;
augmented: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
dotted: NAME ('.' NAME)* ;
yields: 'yield' ('from' e | exprs)? ;
exprs: star (',' star)* ','? ;
star: '*'? e ;
named: e (':=' e)? ;
anything: '*' e | named ('as' NAME)? ;
e: operand (operator operand)* ('if' e 'else' e)? ;
operand: ('not' | '-' | '+' | '~' | 'await')* atom suffix* | 'lambda' lparams? ':' e | 'not'+ 'lambda' lparams? ':' e ;
operator: 'and' | 'or' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? ;
atom: NAME | NUMBER | STRING+ | '...' | 'None' | 'True' | 'False' | '(' (yields | items)? ')' | '[' items? ']' | '{' (pairs | items)? '}' ;
items: anything (comp | (',' anything)* ','?) ;
pairs: pair (comp | (',' pair)* ','?) ;
pair: e ':' named ('as' NAME)? | '**' e ;
comp: ('async'? 'for' exprs 'in' e ('if' named)*)+ ;
suffix: '.' NAME | '(' args? ')' | '[' slice (',' slice)* ','? ']' ;
args: arg (',' arg)* ','? ;
arg: named (comp | 'as' NAME)? | NAME '=' e ('as' NAME)? | '*' e | '**' e ;
slice: e? ':' e? (':' e?)? | '*' e | named ;
params: param (',' param)* ','? ;
param: NAME (':' e)? ('=' e)? | '*' (NAME (':' star)?)? | '**' NAME (':' e)? | '/' ;
lparams: lparam (',' lparam)* ','? ;
lparam: NAME ('=' e)? | '*' NAME? | '**' NAME | '/' ;
typeparams: '[' typeparam (',' typeparam)* ','? ']' ;
typeparam: ('*' | '**')? NAME (':' e)? ('=' star)? ;
funcdef: 'def' NAME typeparams? '(' params? ')' ('->' exprs)? ':' block ;
classdef: 'class' NAME typeparams? ('(' args? ')')? ':' block ;
decorated: ('@' named NEWLINE)+ ('async'? funcdef | classdef) ;
ifs: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? ;
whiles: 'while' named ':' block ('else' ':' block)? ;
fors: 'for' exprs 'in' exprs ':' block ('else' ':' block)? ;
trys: 'try' ':' block (('except' '*'? (e (',' e)* ('as' NAME)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block) ;
withs: 'with' ('(' within (',' within)* ','? ')' | within (',' within)*) ':' block ;
within: e ('as' star)? ;
matchs: 'match' exprs ':' NEWLINE INDENT ('case' anything (',' anything)* ','? ('if' named)? ':' block)+ DEDENT ;
"""
PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"

_SCRIPT = r"""
module: item* END ;
semi: ';' | LINE ;
item: imports | exports | statement ;
imports: 'import' STRING withs? semi | 'import' TYPEWORD ('*' 'as' NAME | NAME (',' ('*' 'as' NAME | names))? | names) 'from' STRING withs? semi ;
withs: ('with' | 'assert') object ;
names: '{' (name (',' name)* ','?)? '}' ;
name: TYPEWORD (WORD | STRING) ('as' (WORD | STRING))? ;
exports: 'export' TYPEWORD ('*' ('as' (WORD | STRING))? 'from' STRING withs? semi | names ('from' STRING withs?)? semi) | DECORATORS 'export' 'default'? declaration | 'export' 'default' -('function' | 'class') assign semi ;
declaration: lets semi | function | class MOREDECLARATIONS ;
function: 'async'? 'function' '*'? NAME? TYPEPARAMS params RETURNS (block | BODYLESS) ;
lets: ('const' | 'let' | 'var') let (',' let)* ;
let: target TYPED ('=' assign)? ;
target: NAME | '[' ','* (element (','+ element)*)? ','* ']' | '{' (field (',' field)* ','?)? '}' ;
element: '...'? target ('=' assign)? ;
field: '...' target | key ':' target ('=' assign)? | NAME ('=' assign)? ;
params: '(' (param (',' param)* ','?)? ')' ;
param: PARAMMODS '...'? (target | THISWORD) OPTIONAL TYPED ('=' assign)? ;
block: '{' statement* '}' ;
statement: block | ';' | lets semi | function | class | 'if' '(' expr ')' statement ('else' statement)? | 'for' 'await'? '(' (lets | expr)? ';' expr? ';' expr? ')' statement
  | 'for' 'await'? '(' (('const' | 'let' | 'var') target | expr) ('of' | 'in') expr ')' statement | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'?
  | ('continue' | 'break') NAME? semi | 'return' expr? semi | 'throw' expr semi | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' statement*)* '}'
  | 'try' block ('catch' ('(' target TYPED ')')? block ('finally' block)? | 'finally' block) | 'debugger' semi | NAME ':' statement | -('{' | 'function' | 'class') expr semi MORESTATEMENTS ;
class: DECORATORS 'class' NAME? TYPEPARAMS ('extends' operand)? IMPLEMENTS '{' (member | ';')* '}' ;
member: 'static' block | DECORATORS ('static' MEMBERMODS | MEMBERMODS) ((('async' | 'get' | 'set')? '*'? memberkey OPTIONAL TYPEPARAMS params RETURNS (block | BODYLESS)) | 'accessor'? memberkey OPTIONAL TYPED ('=' assign)? semi INDEXMEMBER) ;
memberkey: WORD | STRING | NUMBER | '[' assign ']' | '#' WORD ;
key: WORD | STRING | NUMBER | '[' assign ']' ;
expr: assign (',' assign)* ;
assign: operand (binary operand | '?' assign ':' operand CASTS)* ;
operand: prefix* atom suffix* | arrow | 'yield' '*'? assign | 'yield' ;
prefix: 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | '++' | '--' | 'await' | 'new' PREFIXTYPES ;
binary: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '>' '>=' | '>' '>' '>=' | '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>' | '>' '>' | '>' '>' '>' | '<' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
atom: NAME | NUMBER | STRING | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | array | object | function | class | 'new' '.' 'target' | 'import' ('.' NAME | '(' expr ','? ')') | '#' NAME ;
array: '[' ','* (spread (','+ spread)*)? ','* ']' ;
spread: '...'? assign ;
object: '{' (property (',' property)* ','?)? '}' ;
property: '...' assign | ('async' | 'get' | 'set')? '*'? key TYPEPARAMS params RETURNS block | key ':' assign | NAME ('=' assign)? ;
arrow: 'async'? (NAME | TYPEPARAMS params RETURNS) '=>' (block | -'{' assign) ;
suffix: '.' (WORD | '#' WORD) | '?.' (WORD | '#' WORD | '[' expr ']' | TYPEARGS arguments) | '[' expr ']' | arguments | STRING | '++' | '--' MORESUFFIX ;
arguments: '(' (spread (',' spread)* ','?)? ')' ;
"""
_PLAIN = dict.fromkeys("TYPEWORD DECORATORS MOREDECLARATIONS TYPEPARAMS RETURNS TYPED PARAMMODS THISWORD OPTIONAL MORESTATEMENTS IMPLEMENTS MEMBERMODS INDEXMEMBER CASTS PREFIXTYPES TYPEARGS MORESUFFIX BODYLESS".split(), "")
_PLAIN |= {"DECORATORS": "decorator*", "THISWORD": "NAME", "BODYLESS": "block"}
_TYPED = {
    "TYPEWORD": "'type'?", "DECORATORS": "decorator*", "TYPEPARAMS": "typeparams?", "RETURNS": "(':' returntype)?", "TYPED": "('!'? ':' type)?", "PARAMMODS": "decorator* ('public' | 'private' | 'protected' | 'readonly' | 'override')*", "THISWORD": "'this'",
    "OPTIONAL": "'?'?", "IMPLEMENTS": "('implements' type (',' type)*)?", "MEMBERMODS": "('static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async')*", "BODYLESS": "semi",
    "INDEXMEMBER": "| 'static'? 'readonly'? '[' NAME ':' type ']' ':' type semi", "CASTS": "| ('as' | 'satisfies') type", "PREFIXTYPES": "| '<' type '>'", "TYPEARGS": "typeargs?", "MORESUFFIX": "| '!' | typeargs",
    "MOREDECLARATIONS": "| 'abstract' class | interface | alias | enum | namespace | 'declare' (lets semi | function | 'abstract'? class | interface | alias | enum | namespace | 'global' block) | 'import' NAME '=' expr semi",
    "MORESTATEMENTS": "| 'abstract' class | interface | alias | enum | namespace | 'declare' (lets semi | function | 'abstract'? class | interface | alias | enum | namespace | 'global' '{' item* '}') | 'import' NAME '=' expr semi | 'export' '=' expr semi",
}
_TYPES = r"""
interface: 'interface' NAME typeparams? ('extends' type (',' type)*)? members ;
alias: 'type' NAME typeparams? '=' type semi ;
enum: 'const'? 'enum' NAME '{' (key ('=' assign)? (',' key ('=' assign)?)* ','?)? '}' ;
namespace: ('namespace' | 'module') (STRING | NAME ('.' NAME)*) ('{' item* '}' | semi) ;
members: '{' (';' | ',' | typemember (';' | ',' | LINE))* '}' ;
typemember: ('readonly' | '+' 'readonly' | '-' 'readonly')* (key '?'? (':' type)? | '[' NAME (':' | 'in') type ('as' type)? ']' (('-' | '+')? '?')? (':' type)? | ('get' | 'set')? key? '?'? typeparams? params (':' returntype)? | 'new' typeparams? params (':' type)?) ;
typeparams: '<' typeparam (',' typeparam)* ','? '>' ;
typeparam: ('const' | 'in' | 'out')* NAME ('extends' type)? ('=' type)? ;
typeargs: '<' type (',' type)* ','? '>' ;
returntype: type | 'asserts' (NAME | 'this') ('is' type)? | (NAME | 'this') 'is' type ;
type: 'abstract'? 'new' typeparams? params '=>' returntype | typeparams? params '=>' returntype | '|'? '&'? part (('|' | '&') part)* ('extends' type '?' type ':' type)? ;
part: ('keyof' | 'unique' | 'readonly' | 'infer')* (NAME typeargs? | NAME 'extends' part | 'this' | 'void' | 'null' | 'true' | 'false' | '-'? NUMBER | STRING | 'typeof' ('import' '(' STRING ')' | WORD) ('.' (WORD | '#' WORD))* typeargs? | '(' type ')' | members | '[' (tuple (',' tuple)* ','?)? ']' | 'import' '(' STRING ')') partsuffix* ;
partsuffix: '.' WORD typeargs? | '[' type? ']' ;
tuple: '...'? (WORD '?'? ':')? type '?'? ;
"""
_DECORATOR = "\ndecorator: '@' ('(' expr ')' | NAME ('.' WORD)*) TYPEARGS arguments? ;\n"


def _script(parts: dict[str, str], extra: str) -> str:
    text = _SCRIPT + _DECORATOR + extra
    return re.sub(r"\b(" + "|".join(parts) + r")\b", lambda m: parts[m[1]], text)


JAVASCRIPT = _script(_PLAIN, "")
TYPESCRIPT = _script(_TYPED, _TYPES)
SCRIPT_WORDS = "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static implements interface package private protected public"
TYPESCRIPT_WORDS = "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield"

GO = r"""
file: 'package' NAME ';' ('import' (spec | '(' (spec (';' spec)* ';'?)? ')') ';')* (declaration ';')* END ;
spec: (NAME | '.')? STRING ;
declaration: 'func' ('(' (parameter (',' parameter)* ','?)? ')')? NAME typeparams? signature block? | vars ;
vars: 'var' (var | '(' (var (';' var)* ';'?)? ')') | 'const' (const | '(' (const (';' const)* ';'?)? ')') | 'type' (typespec | '(' (typespec (';' typespec)* ';'?)? ')') ;
var: names (type ('=' exprs)? | '=' exprs) ;
const: names (type? '=' exprs)? ;
typespec: NAME typeparams? '='? type ;
typeparams: '[' names constraint (',' names constraint)* ','? ']' ;
constraint: '~'? type ('|' '~'? type)* ;
names: NAME (',' NAME)* ;
signature: '(' (parameter (',' parameter)* ','?)? ')' (type | '(' (parameter (',' parameter)* ','?)? ')')? ;
parameter: NAME? '...'? type ;
type: NAME ('.' NAME)? ('[' type (',' type)* ','? ']')? | '*' type | '(' type ')' | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | ('chan' '<-'? | '<-' 'chan') type | 'func' signature | struct | interface ;
struct: 'struct' '{' ((names type | '*'? NAME ('.' NAME)? ('[' type (',' type)* ']')?) STRING? (';' | -(NAME | '*')))* '}' ;
interface: 'interface' '{' ((NAME signature | constraint) (';' | -(NAME | '~')))* '}' ;
block: '{' statements '}' ;
statements: (statement? ';')* statement? ;
statement: vars | simple | NAME ':' statement? | 'go' expr | 'defer' expr | 'return' exprs? | ('break' | 'continue' | 'goto') NAME? | 'fallthrough' | block | ifs
  | 'switch' (simple? ';')? simple? '{' (('case' alternatives | 'default') ':' statements)* '}' | 'select' '{' (('case' simple | 'default') ':' statements)* '}'
  | 'for' (expr | simple? ';' expr? ';' simple? | (exprs (':=' | '='))? 'range' expr)? block ;
alternatives: (expr | type) (',' (expr | type))* ;
ifs: 'if' (simple? ';')? expr block ('else' (ifs | block))? ;
simple: exprs (('++' | '--') | '<-' expr | ('=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=') exprs)? ;
exprs: expr (',' expr)* ;
expr: operand (('||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^') operand)* ;
operand: ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* atom suffix* ;
atom: NAME | NUMBER | STRING | '(' (expr | type) ')' | 'func' signature block | -(NAME | '(') literaltype (literal | '(' expr ','? ')') | -(NAME | '(') literaltype ;
literaltype: '[' (expr | '...')? ']' type | 'map' '[' type ']' type | struct | interface | 'chan' type ;
suffix: '.' (NAME | '(' (type | 'type') ')') | '[' (expr | type) (',' type)* ','? ']' | '[' expr? ':' expr? (':' expr)? ']' | '(' (argument (',' argument)* '...'? ','?)? ')' | literal ;
argument: expr | type ;
literal: '{' (entry (',' entry)* ','?)? '}' ;
entry: (expr | literal) (':' (expr | literal))? ;
"""
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"

JAVA = r"""
unit: (annotation* 'package' qualified ';')? ('import' 'static'? qualified ('.' '*')? ';' | ';')* (typedecl | ';')* END ;
modules: ('import' 'static'? qualified ('.' '*')? ';')* annotation* 'open'? 'module' qualified '{' (('requires' ('transitive' | 'static')* qualified | ('exports' | 'opens') qualified ('to' qualified (',' qualified)*)? | 'uses' qualified | 'provides' qualified 'with' qualified (',' qualified)*) ';')* '}' END ;
qualified: NAME ('.' NAME)* ;
annotation: '@' qualified ('(' ((NAME '=' value (',' NAME '=' value)*) | value)? ')')? ;
value: expr | annotation | '{' (value (',' value)*)? ','? '}' ;
modifier: annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
typedecl: modifier* (class | interface | enum | record | '@' 'interface' NAME '{' (modifier* (type NAME '(' ')' ('default' value)? ';' | fields ';') | typedecl | ';')* '}') ;
class: 'class' NAME typeparams? ('extends' type)? ('implements' type (',' type)*)? ('permits' type (',' type)*)? body ;
interface: 'interface' NAME typeparams? ('extends' type (',' type)*)? ('permits' type (',' type)*)? body ;
enum: 'enum' NAME ('implements' type (',' type)*)? '{' (constant (',' constant)*)? ','? (';' member*)? '}' ;
constant: annotation* NAME arguments? body? ;
record: 'record' NAME typeparams? '(' (annotation* type '...'? NAME (',' annotation* type '...'? NAME)*)? ')' ('implements' type (',' type)*)? body ;
body: '{' member* '}' ;
member: ';' | 'static'? block | typedecl | modifier* (fields ';' | typeparams? (annotation* type | 'void') NAME params dims ('throws' type (',' type)*)? (block | ';') | typeparams? NAME params ('throws' type (',' type)*)? block | NAME block) ;
fields: type variable (',' variable)* ;
variable: NAME dims ('=' (expr | arrayinit))? ;
dims: (annotation* '[' ']')* ;
arrayinit: '{' ((expr | arrayinit) (',' (expr | arrayinit))*)? ','? '}' ;
params: '(' (param (',' param)*)? ')' ;
param: modifier* type annotation* '...'? (NAME ('.' 'this')? | 'this') dims ;
typeparams: '<' typeparam (',' typeparam)* '>' ;
typeparam: annotation* NAME ('extends' type ('&' type)*)? ;
type: annotation* (primitive | NAME typeargs? ('.' annotation* NAME typeargs?)*) dims ;
primitive: 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short' ;
typeargs: '<' (typearg (',' typearg)*)? '>' ;
typearg: type | annotation* '?' (('extends' | 'super') type)? ;
block: '{' statement* '}' ;
statement: block | ';' | modifier* fields ';' | typedecl | exprstatement ';' | NAME ':' statement | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
  | 'for' '(' (modifier* fields | exprstatement (',' exprstatement)*)? ';' expr? ';' (exprstatement (',' exprstatement)*)? ')' statement | 'for' '(' modifier* type NAME dims ':' expr ')' statement
  | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') NAME? ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | switch
  | 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' modifier* type ('|' type)* NAME ')' block)* ('finally' block)? ;
resource: modifier* type NAME '=' expr | expr ;
switch: 'switch' '(' expr ')' '{' (label ':' statement* | label '->' (expr ';' | block | 'throw' expr ';'))* '}' ;
label: 'case' pattern (',' pattern)* | 'default' ;
pattern: expr | modifier* type NAME ;
exprstatement: ('++' | '--') operand | target (assignment expr | '++' | '--' | assigned) | call ;
assigned: assignment expr ;
target: atom suffix* ;
call: atom suffix* callsuffix | 'new' creator suffix* | ('this' | 'super') arguments ;
callsuffix: ('.' typeargs? (NAME | 'super'))? arguments ;
assignment: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
expr: operand (binary operand | 'instanceof' ('final'? type NAME?) | '?' expr ':' operand)* ;
binary: assignment | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' ;
operand: ('+' | '-' | '!' | '~' | '++' | '--' | '(' type ('&' type)* ')')* (atom suffix* ('++' | '--')* | lambda | switch) ;
lambda: (NAME | '(' (NAME (',' NAME)*)? ')' | params) '->' (expr | block) ;
atom: NAME | NUMBER | STRING | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' creator | type '::' (NAME | 'new') | (primitive | NAME) dims '.' 'class' | 'void' '.' 'class' ;
creator: annotation* (primitive | NAME typeargs? ('.' NAME typeargs?)*) (arguments body? | dims arrayinit | (annotation* '[' expr ']')+ dims) ;
suffix: '.' (typeargs? NAME | 'this' | 'class' | 'new' typeargs? creator | typeargs? 'super') | '[' expr ']' | arguments | '::' typeargs? (NAME | 'new') ;
arguments: '(' (expr (',' expr)*)? ')' ;
"""
JAVA_WORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"

RUST = r"""
file: inner* item* END ;
inner: '#' '!' '[' tree* ']' ;
outer: '#' '[' tree* ']' ;
tree: '(' tree* ')' | '[' tree* ']' | '{' tree* '}' | WORD | NUMBER | STRING | LIFETIME | punct ;
punct: '+' | '-' | '*' | '/' | '%' | '^' | '!' | '&' | '|' | '&&' | '||' | '<<' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '=' | '==' | '!=' | '>' | '<' | '>=' | '<=' | '@' | '.' | '..' | '...' | '..=' | ',' | ';' | ':' | '::' | '->' | '=>' | '#' | '$' | '?' | '~' ;
visibility: 'pub' ('(' ('crate' | 'self' | 'super' | 'in' simplepath) ')')? ;
simplepath: '::'? segment ('::' segment)* ;
segment: NAME | 'crate' | 'self' | 'super' | 'Self' ;
item: outer* visibility? (use | function | struct | enum | union | impl | trait | module | constant | typealias | foreign | 'extern' 'crate' (NAME | 'self') ('as' NAME)? ';') | outer* macroitem ;
macroitem: simplepath '!' NAME? ('(' tree* ')' ';' | '[' tree* ']' ';' | '{' tree* '}') ;
use: 'use' usetree ';' ;
usetree: (simplepath? '::')? ('*' | '{' (usetree (',' usetree)* ','?)? '}') | simplepath ('as' NAME)? ;
module: 'unsafe'? 'mod' NAME (';' | '{' inner* item* '}') ;
foreign: 'unsafe'? 'extern' STRING? '{' inner* item* '}' ;
constant: 'const' (NAME | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? NAME ':' type ('=' expr)? ';' ;
typealias: 'type' NAME generics? (':' bounds?)? where? ('=' type)? where? ';' ;
function: ('const' | 'async' | 'unsafe' | 'extern' STRING? | 'default' | 'safe')* 'fn' NAME generics? '(' (parameter (',' parameter)* ','?)? ')' ('->' type)? where? (block | ';') ;
parameter: outer* (('&' LIFETIME?)? 'mut'? 'self' (':' type)? | pattern ':' type | '...') ;
struct: 'struct' NAME generics? (where? '{' (structfield (',' structfield)* ','?)? '}' | ('(' (tuplefield (',' tuplefield)* ','?)? ')')? where? ';') ;
union: 'union' NAME generics? where? '{' (structfield (',' structfield)* ','?)? '}' ;
structfield: outer* visibility? NAME ':' type ;
tuplefield: outer* visibility? type ;
enum: 'enum' NAME generics? where? '{' (variant (',' variant)* ','?)? '}' ;
variant: outer* visibility? NAME ('{' (structfield (',' structfield)* ','?)? '}' | '(' (tuplefield (',' tuplefield)* ','?)? ')')? ('=' expr)? ;
impl: ('default' | 'unsafe')* 'impl' generics? 'const'? ('!'? type 'for')? type where? '{' inner* associated* '}' ;
trait: ('unsafe' | 'auto')* 'trait' NAME generics? (':' bounds?)? where? '{' inner* associated* '}' ;
associated: outer* visibility? (function | constant | typealias) | outer* macroitem ;
generics: '<' (generic (',' generic)* ','?)? '>' ;
generic: outer* (LIFETIME (':' LIFETIME ('+' LIFETIME)*)? | NAME (':' bounds?)? ('=' type)? | 'const' NAME ':' type ('=' (block | '-'? NUMBER | NAME | 'true' | 'false'))?) ;
where: 'where' (predicate (',' predicate)* ','?)? ;
predicate: LIFETIME ':' bounds? | forlifetimes? type ':' bounds? ;
bounds: bound ('+' bound)* '+'? ;
bound: LIFETIME | '(' bound ')' | ('?' | '~' 'const' | 'async')? forlifetimes? path | 'use' '<' (NAME | LIFETIME | ',')* '>' ;
forlifetimes: 'for' generics ;
type: forlifetimes? typepart ;
typepart: path ('!' delimited)? | '<' type ('as' path)? '>' ('::' pathsegment)+ | '(' (type (',' type)* ','?)? ')' | '!' | '_' | ('*' ('const' | 'mut')) type | ('&' | '&&') LIFETIME? 'mut'? type | '[' type (';' expr)? ']' | ('unsafe' | 'extern' STRING? | 'async')* 'fn' '(' (fnparam (',' fnparam)* ','?)? ')' ('->' type)? | ('impl' | 'dyn') bounds ;
fnparam: outer* ((NAME | '_') ':')? type | '...' ;
path: '::'? pathsegment ('::' pathsegment)* ;
pathsegment: segment ('::'? genericargs | '(' (type (',' type)* ','?)? ')' ('->' type)?)? ;
genericargs: '<' (genericarg (',' genericarg)* ','?)? '>' ;
genericarg: LIFETIME | type | '-'? NUMBER | STRING | block | 'true' | 'false' | NAME genericargs? ('=' type | ':' bounds) ;
exprpath: ('::'? segment | '<' type ('as' path)? '>') ('::' (segment | genericargs))* ;
block: '{' inner* statement* expr? '}' ;
statement: ';' | item | outer* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | outer* expr ';' | outer* blocklike ;
blocklike: (LIFETIME ':')? ('loop' block | 'while' expr block | 'for' pattern 'in' expr block | block) | ('unsafe' | 'const' | 'async' 'move'?) block | ifs | match | exprpath '!' '{' tree* '}' ;
ifs: 'if' expr block ('else' (ifs | block))? ;
match: 'match' expr '{' inner* arm* '}' ;
arm: outer* '|'? pattern ('if' expr)? '=>' (expr ',' | blocklike ','? | expr -(WORD | NUMBER | STRING | '_' | '(' | '[' | '&' | '|' | '<' | '#' | '-')) ;
expr: operand (binary operand | 'as' type)* | range ;
range: (operand (binary operand | 'as' type)*)? ('..' | '..=') (operand (binary operand | 'as' type)*)? ;
binary: '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>=' | '..' | '..=' ;
operand: ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut'))* (atom suffix*) | closure | 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? | 'let' pattern '=' operand | '_' ;
closure: forlifetimes? 'static'? 'async'? 'move'? ('||' | '|' (closureparam (',' closureparam)* ','?)? '|') ('->' type block | expr) ;
closureparam: outer* patternpart (':' type)? ;
atom: NUMBER | STRING+ | 'true' | 'false' | exprpath | exprpath '!' delimited | exprpath '{' (exprfield (',' exprfield)* ','?)? ('..' expr?)? '}' | '(' outer* (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?))? ']' | blocklike ;
delimited: '(' tree* ')' | '[' tree* ']' | '{' tree* '}' ;
exprfield: outer* ((NAME | NUMBER) ':' expr | NAME) ;
suffix: '?' | '.' (NAME ('::' genericargs)? | NUMBER | 'await') | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' ;
pattern: '|'? patternpart ('|' patternpart)* ;
patternpart: '_' | '..' | ('ref')? 'mut'? NAME ('@' patternpart)? | bound2 (('..=' | '...' | '..') bound2?)? | ('..=' | '..') bound2 | ('&' | '&&') 'mut'? patternpart | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']'
  | exprpath ('(' (pattern (',' pattern)* ','?)? ')' | '{' (outer* patternfield (',' outer* patternfield)* ','?)? '}' | '!' delimited)? ;
patternfield: '..' | 'ref'? 'mut'? NAME (':' pattern)? | NUMBER ':' pattern ;
bound2: '-'? NUMBER | STRING | exprpath | 'true' | 'false' ;
"""
RUST_WORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while _"

_DEFINITIONS = {
    "python": (PYTHON, ("file",), PYTHON_WORDS),
    "javascript": (JAVASCRIPT, ("module",), SCRIPT_WORDS),
    "typescript": (TYPESCRIPT, ("module",), TYPESCRIPT_WORDS),
    "go": (GO, ("file",), GO_WORDS),
    "rust": (RUST, ("file",), RUST_WORDS),
    "java": (JAVA, ("unit", "modules"), JAVA_WORDS),
}


@lru_cache(None)
def grammar(language: str) -> Grammar:
    text, starts, words = _DEFINITIONS[language]
    return Grammar(text, starts, set(words.split()), ("NAME", "NUMBER", "STRING", "REGEX", "LIFETIME", "NEWLINE", "INDENT", "DEDENT"))


_DIGITS = r"(?:\d(?:_?\d)*)"
_NUMBERS = {
    "python": rf"(?i)0x(?:_?[0-9a-f])+|0o(?:_?[0-7])+|0b(?:_?[01])+|(?:{_DIGITS}\.?{_DIGITS}?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?j?",
    "javascript": rf"(?i)(?:0x(?:_?[0-9a-f])+|0o(?:_?[0-7])+|0b(?:_?[01])+|{_DIGITS})n?|(?:{_DIGITS}\.?{_DIGITS}?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?",
    "go": rf"(?i)(?:0x[0-9a-f_]+(?:\.[0-9a-f_]*)?(?:p[+-]?\d+)?|0o?[0-7_]+|0b[01_]+|(?:{_DIGITS}\.?{_DIGITS}?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)i?",
    "java": rf"(?i)(?:0x[0-9a-f_]+(?:\.[0-9a-f_]*)?(?:p[+-]?\d+)?|0b[01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:e[+-]?\d+)?)[lfd]?",
    "rust": r"(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.(?:\d[\d_]*)?)?(?:[eE][+-]?[\d_]+)?)(?:_?(?:[ui](?:8|16|32|64|128|size)|f32|f64))?",
}
_NUMBERS["typescript"] = _NUMBERS["javascript"]
_NUMBER = {k: re.compile(v) for k, v in _NUMBERS.items()}
_RUNE = re.compile(r"'(?:[^'\\\n]|\\(?:[^xuU0-7\n]|[0-7]{1,3}|x[0-9a-fA-F]{2}|u+[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'")


def _closed(text: str, language: str) -> bool:
    """Whether a string token is complete."""
    if language == "python":
        body = text.lstrip("rRbBuUfFtT")
        q = body[:3] if body[:3] in ('"""', "'''") else body[:1]
        return len(body) >= 2 * len(q) and body.endswith(q)
    if language == "rust":
        m = re.match(r"(?:br|cr|r)(#*)\"", text)
        if m:
            return len(text) > len(m[0]) and text.endswith('"' + m[1])
        text = text.lstrip("bc")
    if language == "java" and text.startswith('"""'):
        return len(text) >= 7 and text.endswith('"""') and re.match(r'"""[ \t\f]*\r?\n', text) is not None
    if language in ("go", "java") and text[0] == "'":
        return _RUNE.fullmatch(text) is not None
    return len(text) >= 2 and text[0] == text[-1] and (language not in ("go", "java") or text[0] == "`" or "\n" not in text)


def classes(text: str, language: str) -> tuple[list[int], list[bool]] | None:
    """(classes of the tokens with the language's layout rules, line breaks); None for a text that is no token sequence."""
    g = grammar(language)
    if text.startswith("﻿"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    known, reserved = g.classes, g.reserved
    name, number, string, word = known["NAME"], known["NUMBER"], known["STRING"], known["RESERVED"]
    out: list[int] = []
    breaks: list[bool] = []
    fresh = True
    number_ok = _NUMBER[language].fullmatch
    if language == "python":
        return _python(text, g)
    go_end = {known.get(x) for x in (")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return")} | {name, number, string} if language == "go" else set()
    closing = known.get("}")
    for kind, a, b in lexing.tokens(text, language):
        if kind == lexing.NEWLINE or kind == lexing.COMMENT:
            if kind == lexing.COMMENT and text.startswith("/*", a) and (not text.endswith("*/", a + 2, b) or b - a < 4):
                return None
            if kind == lexing.NEWLINE or "\n" in text[a:b]:
                if go_end and out and out[-1] in go_end:
                    out.append(known[";"])
                    breaks.append(False)
                fresh = True
            continue
        part = text[a:b]
        if kind == lexing.NAME:
            c = known.get(part)
            if part in reserved:
                c = word if c is None else c
            elif c is None:
                c = name
            if "\\" in part and language not in ("javascript", "typescript"):
                return None
        elif kind == lexing.SIGN:
            c = known.get(part)
            if c is None:
                return None
        elif kind == lexing.NUMBER:
            if not number_ok(part):
                return None
            c = number
        elif kind == lexing.STRING:
            if not _closed(part, language):
                return None
            c = string
        elif kind == lexing.REGEX:
            c = known["REGEX"]
        elif kind == lexing.LIFETIME:
            c = known["LIFETIME"]
        else:
            return None
        out.append(c)
        breaks.append(fresh or c == closing)
        fresh = False
    if go_end and out and out[-1] in go_end:
        out.append(known[";"])
        breaks.append(False)
    out.append(known["END"])
    breaks.append(True)
    return out, breaks


def _python(text: str, g: Grammar) -> tuple[list[int], list[bool]] | None:
    known, reserved = g.classes, g.reserved
    newline, indent, dedent = known["NEWLINE"], known["INDENT"], known["DEDENT"]
    out: list[int] = []
    levels, depth, begins = [(0, 0)], 0, True
    pairs: list[str] = []
    number_ok = _NUMBER["python"].fullmatch
    toks = lexing.tokens(text, "python")
    skip = False
    for i, (kind, a, b) in enumerate(toks):
        if kind == lexing.COMMENT:
            continue
        if kind == lexing.NEWLINE:
            if skip:
                skip = False
            elif not depth and not begins:
                out.append(newline)
                begins = True
            continue
        if skip:
            return None
        if begins and not depth:
            blank = text[text.rfind("\n", 0, a) + 1 : a].replace("\f", "")
            width, other = 0, len(blank)
            for c in blank:
                width = (width // 8 + 1) * 8 if c == "\t" else width + 1
            here = (width, other)
            if here > levels[-1]:
                if not (here[0] > levels[-1][0] and here[1] > levels[-1][1]):
                    return None
                levels.append(here)
                out.append(indent)
            while here < levels[-1]:
                levels.pop()
                out.append(dedent)
            if here != levels[-1]:
                return None
            begins = False
        part = text[a:b]
        if kind == lexing.NAME:
            c = known.get(part)
            if c is None:
                c = known["RESERVED"] if part in reserved else known["NAME"]
        elif kind == lexing.SIGN:
            if part == "\\":
                if i + 1 < len(toks) and toks[i + 1][0] == lexing.NEWLINE and toks[i + 1][1] == b:
                    skip = True
                    continue
                return None
            c = known.get(part)
            if c is None:
                return None
            if part in "([{":
                depth += 1
                pairs.append(part)
            elif part in ")]}":
                if not pairs or pairs.pop() + part not in ("()", "[]", "{}"):
                    return None
                depth -= 1
        elif kind == lexing.NUMBER:
            if not number_ok(part) or (re.fullmatch(r"0[\d_]*[1-9][\d_]*", part)):
                return None
            c = known["NUMBER"]
        elif kind == lexing.STRING:
            if not _closed(part, "python"):
                return None
            c = known["STRING"]
        else:
            return None
        out.append(c)
    if depth or skip:
        return None
    if not begins:
        out.append(newline)
    out += [dedent] * (len(levels) - 1)
    out.append(known["END"])
    return out, [False] * len(out)


def valid(text: str, language: str) -> bool:
    """Whether a text is in the language of any of its dialects' grammars."""
    found = classes(text, language)
    return found is not None and grammar(language).accepts_tokens(*found)
