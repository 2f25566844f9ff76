"""The grammars of the six languages and the words of their lexers.

Fixed values: keywords and operators are those of the language definitions (Python 3.11, ECMAScript
modules, TypeScript, Go, Rust 2021, Java 17).
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------- JavaScript and TypeScript

JS_RESERVED = """break case catch class const continue debugger default delete do else enum export extends finally for function if
import in instanceof new return super switch this throw try typeof var void while with null true false implements interface let
package private protected public static yield await""".split()
JS_CONTEXTUAL = "as async from get of set target meta".split()
TS_CONTEXTUAL = """abstract accessor any asserts assert bigint boolean constructor declare global infer is keyof module namespace never number
object out override readonly require satisfies string symbol type undefined unique unknown using""".split()
JS_OPS = """>>>= ... === !== **= <<= >>= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** { } ( ) [ ] ; , < > + - * / %
& | ^ ! ~ ? : = . @ #""".split()

_JS_SHARED = r"""
Module = Item*
Item := Import / Export / Stmt
Eos = ';' / &END / NLB
Import = 'import' STR Attr? Eos / 'import' TypeOnly? ImportClause 'from' STR Attr? Eos / ImportEquals
ImportClause = B(ImportSpecs) / NsImport / Id (',' (NsImport / B(ImportSpecs)))?
NsImport = '*' 'as' Id
ImportSpecs = (ImportSpec (',' ImportSpec)* ','?)?
ImportSpec = TypeOnly (WORD / STR) 'as' Id / TypeOnly Id &(',' / END) / (WORD / STR) 'as' Id / Id
Attr = ('with' / NONL 'assert') B(Props)
Export = Decorator* 'export' (ExportMore / '*' ('as' (WORD / STR))? 'from' STR Attr? Eos / TypeOnly? B(ExportSpecs) ('from' STR Attr?)? Eos / 'default' ExportDefault / LexDecl / VarStmt / FuncDecl / ClassDecl / Declaration)
ExportDefault = AnonFunc / Decorator* AnonClass / DefaultMore / !('function' / 'class') Assign Eos
ExportSpecs = (ExportSpec (',' ExportSpec)* ','?)?
ExportSpec = TypeOnly? (WORD / STR) ('as' (WORD / STR))?
Stmt := Block / VarStmt / LexDecl / ';' / If / For / 'while' P(Expr) Stmt / 'do' Stmt 'while' P(Expr) ';'? / ('continue' / 'break') (NONL Id)? Eos / Return (NONL !END !';' Expr)? Eos / 'throw' NONL Expr Eos / Try / 'switch' P(Expr) B(Cases) / 'debugger' Eos / FuncDecl / ClassDecl / Declaration / Id ':' Stmt / ExprStmt
ExprStmt = !('function' / 'class' / BRACEDANY) Expr Eos
BRACEDANY = B(ANY*)
Block = B(StmtList)
StmtList = Stmt*
VarStmt = 'var' VarBinding (',' VarBinding)* Eos
VarBinding = Id Bang? Ann? Init? / Pattern Ann? Init
LexDecl = ('let' VarBinding (',' VarBinding)* / 'const' ConstBinding (',' ConstBinding)*) Eos
ConstBinding = (Id / Pattern) Ann? Init
Pattern = B(ObjPat) / S(ArrPat)
ObjPat = (ObjPatProp (',' ObjPatProp)* (',' RestPat)? ','? / RestPat)?
ObjPatProp = PropKey ':' BindElem / Id Init?
RestPat = '...' (Id / Pattern)
ArrPat = ','* (ArrPatEl (','+ ArrPatEl)* ','*)?
ArrPatEl = RestPat / BindElem
BindElem = (Id / Pattern) Init?
Init = '=' Assign
If = 'if' P(Expr) Stmt ('else' Stmt)?
For = 'for' Await? P(ForHead) Stmt
ForHead = (('var' / 'let' / 'const') (Id / Pattern) / ForTarget) ('of' Assign / 'in' Expr) / ForInit? ';' Expr? ';' Expr?
ForTarget = Target / S(ArrLit) / B(Props)
ForInit = ('var' / 'let') VarBinding (',' VarBinding)* / 'const' ConstBinding (',' ConstBinding)* / Expr
Try = 'try' Block ('catch' P(CatchParam)? Block ('finally' Block)? / 'finally' Block)
CatchParam = (Id / Pattern) Ann?
Cases = (('case' Expr / 'default') ':' Stmt*)*
FuncDecl = 'function' ('*' Id FuncRest_G / Id FuncRest_F) / 'async' NONL 'function' ('*' Id FuncRest_AG / Id FuncRest_A)
AnonFunc = 'function' ('*' Id? FuncRest_G / Id? FuncRest_F) / 'async' NONL 'function' ('*' Id? FuncRest_AG / Id? FuncRest_A)
FuncExpr = 'function' ('*' Id? ExprRest_G / Id? ExprRest_F) / 'async' NONL 'function' ('*' Id? ExprRest_AG / Id? ExprRest_A)
FuncRest = TypeParams? P(Params_F) RetAnn? FuncBody
ExprRest = TypeParams? P(Params_F) RetAnn? Block
ClassDecl = Decorator* Abstract? 'class' Id ClassTail
AnonClass = Abstract? 'class' Id? ClassTail
ClassTail = TypeParams? ('extends' Left TypeArgs?)? Implements? B(ClassBody)
Decorator = '@' (P(Expr) / Id ('.' WORD)* P(Args)?)
ClassBody = (';' / Member)*
Member := 'static' Block_S / Decorator* MemberMod* ('get' PropKey P(Empty) RetAnn? FuncBody_F / 'set' PropKey P(Params_F) RetAnn? FuncBody_F / 'async' NONL ('*' PropKey Mark? FuncRest_AG / PropKey Mark? FuncRest_A) / '*' PropKey Mark? FuncRest_G / PropKey Mark? FuncRest_F / PropKey Mark? Ann? Init_S? Eos / IndexSig Eos) / Decorator* PropKey Mark? (FuncRest_F / Ann? Init_S? Eos)
Empty = &END
PropKey = WORD / STR / NUM / PRIV / S(Assign)
Params = (Param (',' Param)* ','? / &END)
Param = Decorator* ParamMod* ('...' (Id / Pattern) Ann? / (Id / Pattern / This) Opt? Ann? Init?)
Expr = Assign (',' Assign)*
Assign := Arrow / Yield ('*' Assign / NONL !END !(')' / ']' / '}' / ',' / ';' / ':') Assign)? / Target AssignOp Assign / (S(ArrLit) / B(Props)) '=' Assign / Cond
AssignOp = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '>>=' / '>>>=' / '>' '>=' / '>' '>' '>='
Arrow = 'async' NONL (Id / TypeParams? P(Params_F) RetAnn?) NONL '=>' ArrowBody_A / (Id / TypeParams? P(Params) RetAnn?) NONL '=>' ArrowBody_F
ArrowBody = Block / !BRACEDANY Assign
Cond = Bin ('?' Assign ':' Assign / '?' Bin ':' Assign)?
# ?? does not mix with && and || without brackets, and no operator stands before the base of **.
Bin = Bits (('??' Bits)+ !LogicOp / (LogicOp Bits)+ !'??')?
LogicOp = '&&' / '||'
Bits = (PRIV 'in')? Unary (BinOp Unary / TypeOp)*
BinOp = '+' / '-' / '**' / '*' / '/' / '%' / '<<' / '>' '>' '>' / '>' '>' / '>=' / '<=' / '<' / '>' / '===' / '!==' / '==' / '!=' / '&' / '|' / '^' / 'instanceof' / 'in'
Unary = ('!' / '~' / '+' / '-' / 'typeof' / 'void' / 'delete' / Await / Assertion)+ Update !'**' / Update
Update = ('++' / '--') Unary / Postfix
Postfix = Left (NONL ('++' / '--'))?
Left = Primary Trailer*
Target = Primary (Trailer &Trailer)* (MemberTrailer !Trailer) / Id NonNull?
Trailer = MemberTrailer / '?.' (WORD / PRIV / S(Expr) / P(Args)) / P(Args) / T(Substituted) / CallTypes / NonNull
MemberTrailer = '.' (WORD / PRIV) / S(Expr)
New = 'new' ('.' 'target' / (New / NewBase) MemberTrailer* TypeArgs? P(Args)?)
NewBase = Id / 'this' / 'super' / P(Expr) / FuncExpr / AnonClass / S(ArrLit) / 'import' '.' WORD
Primary = FuncExpr / Id / NUM / STR / REGEX / T(Substituted) / 'this' / 'super' / 'null' / 'true' / 'false' / P(Expr) / S(ArrLit) / B(Props) / Decorator* AnonClass / New / 'import' (P(Args) / '.' WORD) / X(Markup)
Substituted = B(Expr)*
Markup = (B(MarkupExpr) / X(Markup))*
MarkupExpr = ('...' Assign / Expr)?
Args = (Arg (',' Arg)* ','?)?
Arg = '...'? Assign
ArrLit = ','* (Arg (','+ Arg)* ','*)?
Props = (Prop (',' Prop)* ','?)?
Prop := '...' Assign / 'get' PropKey P(Empty) RetAnn? Block_F / 'set' PropKey P(Params_F) RetAnn? Block_F / 'async' NONL ('*' PropKey ExprRest_AG / PropKey ExprRest_A) / '*' PropKey ExprRest_G / PropKey ExprRest_F / PropKey ':' Assign / Id ('=' Assign)?
"""

_JS_ONLY = r"""
TypeOnly = FAIL
ImportEquals = FAIL
ExportMore = FAIL
DefaultMore = FAIL
Declaration = FAIL
Ann = FAIL
RetAnn = FAIL
Bang = FAIL
Mark = FAIL
Opt = FAIL
This = FAIL
TypeParams = FAIL
TypeArgs = FAIL
CallTypes = FAIL
NonNull = FAIL
TypeOp = FAIL
Assertion = FAIL
Abstract = FAIL
Implements = FAIL
IndexSig = FAIL
FuncBody = Block
ParamMod = FAIL
MemberMod = 'static' &(WORD / STR / NUM / PRIV / SQUAREANY / '*')
SQUAREANY = S(ANY*)
"""

_TS_ONLY = r"""
TypeOnly = 'type' !('from' !'from') !',' / 'typeof'
ImportEquals = 'import' TypeOnly? Id '=' ('require' P(Args) / Id ('.' WORD)*) Eos
ExportMore = '=' Expr Eos / 'as' 'namespace' Id Eos / ImportEquals
DefaultMore = Interface / Abstract AnonClass
Declaration = Interface / 'type' NONL Id TypeParams? '=' Type Eos / 'const'? 'enum' Id B(EnumBody) / ('namespace' / 'module') NONL (Id ('.' Id)* / STR) (B(Module) / Eos) / 'declare' NONL ('global' B(Ambient) / ('namespace' / 'module') NONL (Id ('.' Id)* / STR) (B(Ambient) / Eos) / AmbientVar / Declaration / FuncDecl / ClassDecl / VarStmt) / 'global' B(Module)
Ambient = ('export'? AmbientVar / Item)*
AmbientVar = ('let' / 'const' / 'var') (Id Ann?) (',' Id Ann?)* Init? Eos
Interface = 'interface' NONL Id TypeParams? ('extends' TypeRef (',' TypeRef)*)? B(TypeBody)
EnumBody = (EnumMember (',' EnumMember)* ','?)?
EnumMember = PropKey Init?
Ann = ':' Type
RetAnn = ':' Type
Bang = '!' &':'
Mark = '?' / '!'
Opt = '?'
This = 'this'
Abstract = 'abstract'
Implements = 'implements' TypeRef (',' TypeRef)*
IndexSig = 'readonly'? S(IndexKey) Ann
IndexKey = Id ':' Type
FuncBody = Block / Eos
ParamMod = ('public' / 'private' / 'protected' / 'readonly' / 'override') &(Id / PATTERNANY)
PATTERNANY = B(ANY*) / S(ANY*)
MemberMod = ('static' / 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare' / 'accessor') &(WORD / STR / NUM / PRIV / SQUAREANY / '*')
SQUAREANY = S(ANY*)
TypeOp = NONL ('as' / 'satisfies') ('const' / Type)
Assertion = '<' ('const' / Type) '>'
NonNull = NONL '!' !'='
CallTypes = TypeArgs &(PARENANY / T(ANY*) / ')' / ',' / ';' / '.' / END)
PARENANY = P(ANY*)
TypeArgs = '<' Type (',' Type)* ','? '>'
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam = (('const' / 'in' / 'out') &WORD)* Id ('extends' Type)? ('=' Type)?
Type := 'asserts' NONL (Id / 'this') ('is' Type)? / (Id / 'this') NONL 'is' Type / FnType / Union (NONL 'extends' Union '?' Type ':' Type)?
FnType = ('abstract'? 'new')? TypeParams? P(Params) '=>' Type
Union = ('|' / '&')? UnaryType (('|' / '&') UnaryType)*
UnaryType = FnType / ('keyof' / 'unique' / 'readonly') UnaryType / 'infer' Id (NONL 'extends' UnaryType !'?')? / ArrType
ArrType = PrimType (NONL S(MaybeType))*
MaybeType = Type?
PrimType = P(Type) / B(TypeBody) / S(Tuple) / STR / '-'? NUM / T(TypeParts) / 'this' / 'void' / 'null' / 'true' / 'false' / 'typeof' ('import' P(Args) / Id / 'this') ('.' (WORD / PRIV))* TypeArgs? / 'import' P(Args) ('.' WORD)* TypeArgs? / TypeRef
TypeParts = B(Type)*
TypeRef = Id ('.' WORD)* (NONL TypeArgs)?
Tuple = (TupleEl (',' TupleEl)* ','?)?
TupleEl = '...'? (WORD '?'? ':')? Type '?'?
TypeBody = (TypeMember (';' / ',' / NLB / &END))*
TypeMember := MappedMod? S(Mapped) MappedOpt? Ann? / IndexSig / ('get' / 'set') PropKey P(Params) RetAnn? / 'new'? TypeParams? P(Params) RetAnn? / 'readonly' PropKey Opt? (TypeParams? P(Params) RetAnn? / Ann?) / PropKey Opt? (TypeParams? P(Params) RetAnn? / Ann?)
MappedMod = ('+' / '-')? 'readonly'
Mapped = Id 'in' Type ('as' Type)?
MappedOpt = ('+' / '-')? '?'
"""

# What await, yield and return are in the contexts of a module: its top, functions, async functions, generators, async
# generators, and class fields with static blocks.
_CONTEXTS = {
    "": ("'await'", "FAIL", "FAIL"),
    "_F": ("FAIL", "FAIL", "'return'"),
    "_A": ("'await'", "FAIL", "'return'"),
    "_G": ("FAIL", "'yield'", "'return'"),
    "_AG": ("'await'", "'yield'", "'return'"),
    "_S": ("FAIL", "FAIL", "FAIL"),
}
_PINNED = re.compile(r"\b(\w+?)(_(?:F|AG|A|G|S))\b")


def _in_contexts(text: str) -> str:
    """One copy a context of every rule that leads to await, yield or return; a name with a context's ending is pinned to it."""
    rules = dict(re.fullmatch(r"(\w+)( :?= .*)", line).groups() for line in text.splitlines() if line and not line.startswith("#"))
    bare = {n: re.sub(r"'[^']*'", "", e) for n, e in rules.items()}
    led = {"Await", "Yield", "Return"}
    while more := {n for n, e in bare.items() if n not in led and led & set(re.findall(r"\w+", e))}:
        led |= more
    name = re.compile(r"'[^']*'|\b(" + "|".join(sorted(led, key=len, reverse=True)) + r")\b")
    out = [n + e for n, e in rules.items() if n not in led]
    for ending, words in _CONTEXTS.items():
        out += [n + ending + name.sub(lambda m: m.group() + ending if m.group(1) else m.group(), e) for n, e in rules.items() if n in led]  # noqa: B023
        out += [f"{n}{ending} = {w}" for n, w in zip(("Await", "Yield", "Return"), words)]
    return "\n".join(out)


JAVASCRIPT = _in_contexts(_JS_SHARED + _JS_ONLY)
# What TypeScript's own parser leaves to its checker is left alone here as well: await, yield and return outside of their functions.
TYPESCRIPT = _PINNED.sub(r"\1", _JS_SHARED) + _TS_ONLY + "Await = 'await'\nYield = 'yield'\nReturn = 'return'\n"

# ---------------------------------------------------------------- Java

JAVA_RESERVED = """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally
float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp
super switch synchronized this throw throws transient try void volatile while true false null _""".split()
JAVA_CONTEXTUAL = "record sealed permits non var yield module".split()
JAVA_OPS = """>>>= ... <<= >>= -> :: == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @""".split()

JAVA = r"""
File = (Ann* 'package' QName ';')? (Import / ';')* TopLevel*
QName = Id ('.' Id)*
Import = 'import' 'static'? QName ('.' '*')? ';'
TopLevel := ';' / TypeDecl
TypeDecl = Mod* (Class / Interface / Enum / Record / AnnType)
Mod = Ann / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / 'sealed' &(Mod / 'class' / 'interface') / 'non' '-' 'sealed'
Ann = '@' !'interface' QName P(AnnArgs)?
AnnArgs = (Id '=' ElemVal (',' Id '=' ElemVal)* / ElemVal)?
ElemVal = Ann / B(ElemVals) / Cond
ElemVals = (ElemVal (',' ElemVal)*)? ','?
Class = 'class' Id TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? B(ClassBody)
Interface = 'interface' Id TParams? ('extends' Types)? ('permits' Types)? B(ClassBody)
Enum = 'enum' Id ('implements' Types)? B(EnumBody)
EnumBody = (EnumConst (',' EnumConst)*)? ','? (';' Member*)?
EnumConst = Ann* Id P(Args)? B(ClassBody)?
Record = 'record' Id TParams? P(FParams) ('implements' Types)? B(RecordBody)
AnnType = '@' 'interface' Id B(ClassBody)
Types = Type (',' Type)*
TParams = '<' TParam (',' TParam)* '>'
TParam = Ann* Id ('extends' Type ('&' Type)*)?
ClassBody = Member*
Member := ';' / 'static'? B(Block) / TypeDecl / Mod* (TParams? (Type / 'void') Id P(FParams) Dims? Throws? ('default' ElemVal)? (B(Block) / ';') / TParams? Id P(FParams) Throws? B(Block) / Type VarDecl (',' VarDecl)* ';')
RecordBody = (Mod* Id B(Block) / Member)*
Throws = 'throws' Types
FParams = (FParam (',' FParam)*)?
FParam = (Ann / 'final')* Type Ann* '...'? (Id Dims? / (Id '.')? 'this')
Prim = 'boolean' / 'byte' / 'short' / 'int' / 'long' / 'char' / 'float' / 'double'
Type = Ann* (Prim / ClassType) Dims?
ClassType = Id TArgs? ('.' Ann* Id TArgs?)*
Dims = (Ann* S(Empty))+
Empty = &END
TArgs = '<' (TArg (',' TArg)*)? '>'
TArg = Ann* ('?' (('extends' / 'super') Type)? / Type)
VarDecl = Id Dims? ('=' VarInit)?
VarInit = B(ArrInit) / Expr
ArrInit = (VarInit (',' VarInit)*)? ','?
Block = BStmt*
BStmt := LocalType / LocalVar ';' / Stmt
LocalType = (Ann / 'final' / 'abstract' / 'static' / 'strictfp')* (Class / Interface / Enum / Record)
LocalVar = (Ann / 'final')* Type VarDecl (',' VarDecl)*
Stmt := B(Block) / ';' / 'if' P(Expr) Stmt ('else' Stmt)? / 'while' P(Expr) Stmt / 'do' Stmt 'while' P(Expr) ';' / 'for' P(ForHead) Stmt / 'switch' P(Expr) B(Switch) / Try / 'return' Expr? ';' / 'throw' Expr ';' / ('break' / 'continue') Id? ';' / 'synchronized' P(Expr) B(Block) / 'assert' Expr (':' Expr)? ';' / Id ':' Stmt / 'yield' Expr ';' / StmtExpr ';'
Try = 'try' P(Resources) B(Block) Catch* Finally? / 'try' B(Block) (Catch+ Finally? / Finally)
Catch = 'catch' P(CatchParam) B(Block)
CatchParam = (Ann / 'final')* Type ('|' Type)* Id
Finally = 'finally' B(Block)
Resources = Resource (';' Resource)* ';'?
Resource = (Ann / 'final')* Type Id '=' Expr / Primary
ForHead = (Ann / 'final')* Type Id Dims? ':' Expr / (LocalVar / StmtExpr (',' StmtExpr)*)? ';' Expr? ';' (StmtExpr (',' StmtExpr)*)?
StmtExpr := ('++' / '--') Unary / Target AssignOp Expr / Primary0 Trailer* ('++' / '--') / Called
Called = Primary0 (Trailer &Trailer)* CallTrailer !Trailer / (Id P(Args) / ('this' / 'super') P(Args) / New) !Trailer
CallTrailer = '.' TArgs? Id P(Args) / '.' New
Switch = (SwitchLabel ('->' (B(Block) / 'throw' Expr ';' / Expr ';') / ':' BStmt*))*
SwitchLabel = 'case' CaseLabel (',' CaseLabel)* / 'default'
CaseLabel = 'default' / Cond
Expr := Lambda / Target AssignOp Expr / Cond
AssignOp = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>>>=' / '>' '>=' / '>' '>' '>='
Target = Primary0 (Trailer &Trailer)* ('.' Id / S(Expr)) !Trailer / Id
Lambda = (Id / P(LambdaIds) / P(FParams)) '->' (B(Block) / Expr)
LambdaIds = (Id (',' Id)*)?
Cond = Bin ('?' Expr ':' (Lambda / Cond))?
Bin = Unary (BinOp Unary / 'instanceof' 'final'? Type Id?)*
BinOp = '+' / '-' / '*' / '/' / '%' / '<<' / '>' '>' '>' / '>' '>' / '>=' / '<=' / '<' / '>' / '==' / '!=' / '&&' / '||' / '&' / '|' / '^'
Unary = ('+' / '-' / '++' / '--') Unary / UnaryPlain
UnaryPlain = ('!' / '~') Unary / Cast / Primary ('++' / '--')*
Cast = P(PrimCast) Unary / P(TypeCast) (Lambda / UnaryPlain)
PrimCast = Ann* Prim Dims?
TypeCast = Type ('&' Type)*
Primary = Primary0 Trailer*
Primary0 = LIT / 'this' P(Args)? / 'super' (P(Args) / &'.' / &'::') / New / P(Expr) / 'void' '.' 'class' / 'switch' P(Expr) B(Switch) / (Prim Dims? / ClassType Dims) '.' 'class' / (Prim Dims / ClassType Dims?) '::' ('new' / Id) / Id P(Args) / Id
Trailer = '.' ('class' / 'this' / 'super' / New / TArgs? Id P(Args)?) / S(Expr) / '::' TArgs? ('new' / Id)
New = 'new' Ann* TArgs? (Ann* (Prim / ClassType)) (S(Empty)+ B(ArrInit) / S(Expr)+ Dims? / P(Args) B(ClassBody)?)
Args = (Expr (',' Expr)*)?
"""

# ---------------------------------------------------------------- Go

GO_RESERVED = """break case chan const continue default defer else fallthrough for func go goto if import interface map package range return
select struct switch type var""".split()
GO_OPS = """<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ : = .""".split()
#: A line break after one of these ends a statement.
GO_ENDS = {"ID", "LIT", "STR", "break", "continue", "fallthrough", "return", "++", "--"}

_GO = r"""
File = ';'* 'package' Id ';' (ImportDecl ';'+)* (Top ';'+)*
Top := Const / TypeDecl / Var / Func
ImportDecl = 'import' (ImportSpec / P(ImportSpecs))
ImportSpec = (Id / '.')? STR
ImportSpecs = (ImportSpec (';' ImportSpec)* ';'?)?
Func = 'func' P(Params)? Id S(TypeParams)? Signature B(Block)?
Signature = P(Params) Result?
Result = P(Params) / Type
Params = (Param (',' Param)* ','?)?
Param = Id '...'? Type / '...'? Type
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = Ids Constraint
Constraint = '~'? Type ('|' '~'? Type)*
Ids = Id (',' Id)*
Type := Id ('.' Id)? S(TypeArgs)? / '*' Type / S(ArrLen) Type / 'map' S(Type) Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'func' Signature / 'struct' B(Fields) / 'interface' B(Interface) / P(Type)
TypeArgs = Type (',' Type)* ','?
ArrLen = '...' / Expr / &END
Fields = (Field (';' Field)* ';'?)?
Field = (Ids Type / '*'? Id ('.' Id)? S(TypeArgs)?) STR?
Interface = (Elem (';' Elem)* ';'?)?
Elem = Id Signature / Constraint
Block = ';'* (Stmt (';'+ Stmt)* ';'*)?
Stmt := Const / TypeDecl / Var / Id ':' Stmt? / ('go' / 'defer') Called / 'return' Exprs? / ('break' / 'continue') Id? / 'goto' Id / 'fallthrough' / If / Switch / 'select' B(Cases) / For / B(Block) / Simple
Called = Operand (Trailer &Trailer)* P(Args) !Trailer / P(Expr) !Trailer
Const = 'const' (ConstSpec / P(ConstSpecs))
ConstSpecs = (ConstSpec (';' ConstSpec)* ';'?)?
ConstSpec = Ids (Type? '=' Exprs)?
Var = 'var' (VarSpec / P(VarSpecs))
VarSpecs = (VarSpec (';' VarSpec)* ';'?)?
VarSpec = Ids ('=' Exprs / Type ('=' Exprs)?)
TypeDecl = 'type' (TypeSpec / P(TypeSpecs))
TypeSpecs = (TypeSpec (';' TypeSpec)* ';'?)?
TypeSpec = Id S(TypeParams) Type / Id '='? Type
AssignOp = '=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
If = 'if' (Simple_N ';' Expr_N / ';' Expr_N / Expr_N !':=' !'=') B(Block) ('else' (If / B(Block)))?
Switch = 'switch' ((Simple_N? ';')? Simple_N)? B(Cases) / 'switch' Simple_N ';' B(Cases)
Cases = (('case' (ExprTypes &':' / Simple) / 'default') ':' CaseBlock)*
CaseBlock = ';'* (Stmt (';'+ Stmt)* ';'*)?
For = 'for' ((Exprs_N (':=' / '='))? 'range' Expr_N / Simple_N? ';' Expr_N? ';' Simple_N? / Expr_N)? B(Block)
ExprTypes = ExprType (',' ExprType)*
ExprType = Expr / Type
Args = (ExprType (',' ExprType)* '...'? ','?)?
Index = Expr? ':' Expr? (':' Expr)? / ExprType (',' ExprType)* ','?
Literal = (LitElem (',' LitElem)* ','?)?
LitElem := (LitVal ':')? LitVal
LitVal = B(Literal) / Expr
Trailer = Trailer_N / B(Literal)
Trailer_N = '.' Id / '.' P(TypeAssert) / S(Index) / P(Args)
TypeAssert = 'type' / Type
OperandBase = LIT / STR / 'func' Signature B(Block) / (S(ArrLen) Type / 'map' S(Type) Type / 'struct' B(Fields)) B(Literal) / P(ExprType) / Id / S(ArrLen) Type / 'map' S(Type) Type / 'chan' '<-'? Type / 'struct' B(Fields) / 'interface' B(Interface) / 'func' Signature
"""
_GO_EXPRESSIONS = r"""
Simple@ = Exprs@ AssignOp 'range' Expr@ / Exprs@ AssignOp Exprs@ / Expr@ ('++' / '--') / Expr@ '<-' Expr@ / Expr@
Exprs@ = Expr@ (',' Expr@)*
Expr@ := Unary@ (BinOp@ Unary@)*
BinOp@ = '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&^' / '&'
Unary@ = ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* Operand@ Trailer@*
Operand@ = OperandBase
"""
GO = _GO + _GO_EXPRESSIONS.replace("@", "") + _GO_EXPRESSIONS.replace("@", "_N")

# ---------------------------------------------------------------- Rust

RUST_RESERVED = """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return
self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv typeof unsized virtual
yield try _""".split()
RUST_CONTEXTUAL = "union raw auto default macro_rules".split()
RUST_OPS = """..= ... <<= => -> :: .. && || == != <= >= += -= *= /= %= ^= &= |= << { } ( ) [ ] ; , < > + - * / % ^ ! & | = @ . : # $ ? ~""".split()

_RUST = r"""
File = Inner* Item*
Inner = '#' '!' S(ANY*)
Attr = '#' S(ANY*)
Item := Attr* Vis? (Use / 'mod' Id (';' / B(Mod)) / 'extern' 'crate' ('self' / Id) ('as' (Id / '_'))? ';' / 'unsafe'? 'extern' STR? B(Mod) / Fn / 'struct' Id Gen? (Where? B(Fields) / P(TupleFields) Where? ';' / Where? ';') / 'union' Id Gen? Where? B(Fields) / 'enum' Id Gen? Where? B(Variants) / 'unsafe'? 'auto'? 'trait' Id Gen? (':' Bounds?)? Where? B(Mod) / Impl / 'type' Id Gen? (':' Bounds?)? Where? ('=' Type)? Where? ';' / 'default'? 'const' (Id / '_') ':' Type ('=' Expr)? ';' / 'static' 'mut'? Id ':' Type ('=' Expr)? ';') / Attr* MacroItem
MacroItem = Path '!' Id? (B(Tokens) / (P(Tokens) / S(Tokens)) ';')
Mod = Inner* Item*
Tokens = ANY*
Use = 'use' UseTree ';'
UseTree = '::'? (UseSeg '::')* ('*' / B(UseTrees) / UseSeg ('as' (Id / '_'))?) / B(UseTrees)
UseSeg = Id / 'crate' / 'super' / 'self' / 'Self'
UseTrees = (UseTree (',' UseTree)* ','?)?
Vis = 'pub' P(VisIn)?
VisIn = 'crate' &END / 'super' &END / 'self' &END / 'in' Path
Fn = FnQual* 'fn' Id Gen? P(FnParams) ('->' Type)? Where? (B(Block) / ';')
FnQual = 'default' / 'const' / 'async' / 'unsafe' / 'extern' STR?
FnParams = (FnParam (',' FnParam)* ','?)?
FnParam = Attr* (('&' LIFE?)? 'mut'? 'self' (':' Type)? / '...' / PatOne ':' ('...' / Type))
Impl = 'default'? 'unsafe'? 'impl' (Gen !'::')? '!'? 'const'? Type ('for' Type)? Where? B(Mod)
Fields = (FieldDef (',' FieldDef)* ','?)?
FieldDef = Attr* Vis? Id ':' Type
TupleFields = (Attr* Vis? Type (',' Attr* Vis? Type)* ','?)?
Variants = (Variant (',' Variant)* ','?)?
Variant = Attr* Vis? Id (B(Fields) / P(TupleFields))? ('=' Expr)?
Gen = '<' (GenParam (',' GenParam)* ','?)? '>'
GenParam = Attr* (LIFE (':' (LIFE ('+' LIFE)* '+'?)?)? / 'const' Id ':' Type ('=' (B(Block) / '-'? LIT / Id))? / Id (':' Bounds?)? ('=' Type)?)
Where = 'where' (WherePred (',' WherePred)* ','?)?
WherePred = LIFE ':' (LIFE ('+' LIFE)*)? / ForLife? Type ':' Bounds?
ForLife = 'for' Gen
Bounds = Bound ('+' Bound)* '+'?
Bound = LIFE / P(Bound) / '?'? ForLife? TypePath
Type := ('impl' / 'dyn') Bounds / ('&' / '&&') LIFE? 'mut'? TypeOne / '*' ('const' / 'mut') TypeOne / TypeOne ('+' Bound)*
TypeOne = ('impl' / 'dyn') Bound / ('&' / '&&') LIFE? 'mut'? TypeOne / '*' ('const' / 'mut') TypeOne / S(ArrType) / P(TypeList) / '!' / '_' / ForLife? FnTypeQual* 'fn' P(FnTypeParams) ('->' TypeOne)? / ForLife? TypePath ('!' (P(Tokens) / S(Tokens) / B(Tokens)))?
FnTypeQual = 'unsafe' / 'extern' STR?
FnTypeParams = (FnTypeParam (',' FnTypeParam)* ','?)?
FnTypeParam = Attr* ((Id / '_') ':')? ('...' / Type)
ArrType = Type (';' Expr)?
TypeList = (Type (',' Type)* ','?)?
TypePath = QSelf ('::' TypeSeg)+ / '::'? TypeSeg ('::' TypeSeg)*
QSelf = '<' Type ('as' TypePath)? '>'
TypeSeg = (Id / 'self' / 'Self' / 'super' / 'crate') ('::'? GenArgs / P(TypeList) ('->' TypeOne)?)?
GenArgs = '<' (GenArg (',' GenArg)* ','?)? '>'
GenArg = LIFE / Id GenArgs? ('=' Type / ':' Bounds) / Type / '-'? LIT / STR / B(Block)
Path = QSelf ('::' PathSeg)+ / '::'? PathSeg ('::' PathSeg)*
PathSeg = (Id / 'self' / 'Self' / 'super' / 'crate') ('::' GenArgs)?
Block = Inner* Stmt* TailExpr?
TailExpr = Attr* Expr
Stmt := ';' / Attr* 'let' Pat (':' Type)? ('=' Expr ('else' B(Block))?)? ';' / Item / Attr* BlockLike !('.' / '?') ';'? / Attr* Path '!' B(Tokens) !('.' / '?') / Attr* Expr ';'
BlockLike = (LIFE ':')? ('unsafe'? B(Block) / 'loop' B(Block) / 'while' Cond B(Block) / 'for' Pat 'in' Expr_N B(Block)) / If / Match / 'async' 'move'? B(Block) / 'const' B(Block)
If = 'if' Cond B(Block) ('else' (If / B(Block)))?
Cond = 'let' Pat '=' Expr_N / Expr_N
Match = 'match' Expr_N B(Arms)
Arms = Inner* (Arm (','? Arm)*)? ','?
Arm := Attr* '|'? Pat ('if' Guard)? '=>' (BlockLike &(',' / END / ArmNext) / Expr &(',' / END))
ArmNext = Attr* '|'? Pat ('if' Guard)? '=>'
Guard = 'let' Pat '=' Expr / Expr
Pat = '|'? PatOne ('|' PatOne)*
PatOne := PatRange / '_' / '..' / '-'? LIT / STR / ('&' / '&&') 'mut'? PatOne / 'ref'? 'mut'? Id !('::' / '!' / PARENANY / BRACEANY) ('@' PatOne)? / 'box' PatOne / P(Pats) / S(Pats) / Path '!' (P(Tokens) / S(Tokens) / B(Tokens)) / Path (P(Pats) / B(FieldPats))?
PatRange = PatBound ('..=' / '...') PatBound / PatBound '..' PatBound? / '..=' PatBound
PatBound = '-'? LIT / Path
PARENANY = P(ANY*)
BRACEANY = B(ANY*)
Pats = (Attr* Pat (',' Attr* Pat)* ','?)?
FieldPats = (FieldPat (',' FieldPat)* ','?)?
FieldPat = Attr* ('..' / (Id / LIT) ':' Pat / 'box'? 'ref'? 'mut'? Id)
Exprs = (Attr* Expr (',' Attr* Expr)* ','?)?
Array = Expr ';' Expr / Exprs
StructLit = (FieldInit (',' FieldInit)* (',' '..' Expr?)? ','? / '..' Expr?)?
FieldInit = Attr* ((Id / LIT) ':' Expr / Id)
ClosureParams = ClosureParam (',' ClosureParam)* ','?
ClosureParam = Attr* PatOne (':' Type)?
BinOp = '+' / '-' / '*' / '/' / '%' / '^' / '<<' / '>' '>' '=' / '>' '>=' / '>' '>' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '&&' / '||' / '&' / '|' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '^=' / '&=' / '|=' / '<<='
"""
_RUST_EXPRESSIONS = r"""
Expr@ := (Range@ / Unary@) (BinOp Unary@ / 'as' TypeOne / ('..=' / '..') Unary@ / '..' &(END / ',' / ';' / ')' / BRACEANY))*
Range@ = ('..=' Unary@ / '..' Unary@? )
Unary@ = ('-' / '!' / '*' / ('&' / '&&') ('raw' ('const' / 'mut') / 'mut')?)* (Jump@ / Closure@ / Postfix@)
Jump@ = 'return' Expr@? / 'break' LIFE? Expr@? / 'continue' LIFE? / 'yield' Expr@?
Closure@ = 'static'? 'async'? 'move'? ('||' / '|' ClosureParams? '|') ('->' TypeOne B(Block) / Expr@)
Postfix@ = Primary@ ('?' / '.' ('await' / LIT / Id ('::' GenArgs)? P(Exprs)?) / P(Exprs) / S(Expr))*
"""
RUST = (
    _RUST
    + _RUST_EXPRESSIONS.replace("@", "")
    + _RUST_EXPRESSIONS.replace("@", "_N")
    + r"""
Primary = LIT / STR / BlockLike / Path '!' (P(Tokens) / S(Tokens) / B(Tokens)) / Path B(StructLit) / Path / P(Exprs) / S(Array)
Primary_N = LIT / STR / BlockLike / Path '!' (P(Tokens) / S(Tokens) / B(Tokens)) / Path / P(Exprs) / S(Array)
"""
)

# ---------------------------------------------------------------- Python

PYTHON_RESERVED = """False None True and as assert async await break class continue def del elif else except finally for from global if import in
is lambda nonlocal not or pass raise return try while with yield""".split()
PYTHON_CONTEXTUAL = "match case _".split()
PYTHON_OPS = """**= //= >>= <<= ... -> := == != <= >= += -= *= /= %= &= |= ^= @= ** // << >> { } ( ) [ ] ; , < > + - * / % & | ^ ~ : = . @ !""".split()

PYTHON = r"""
File = Line*
Line := Compound / Simple NL
Simple = Small (';' Small)* ';'?
Suite = NL I(Lines) / Simple NL
Lines = Line+
Small = 'pass' / 'break' / 'continue' / 'return' StarExprs? / 'raise' (Test ('from' Test)?)? / 'global' Names / 'nonlocal' Names / 'del' DelTargets / 'assert' Test (',' Test)? / 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* / 'from' ImportFrom / Assignment / StarExprs
Names = Id (',' Id)*
Dotted = Id ('.' Id)*
ImportFrom = (('.' / '...')* Dotted / ('.' / '...')+) 'import' ('*' / P(ImportNames1) / ImportNames)
ImportNames1 = ImportName (',' ImportName)* ','?
ImportNames = ImportName (',' ImportName)*
ImportName = Id ('as' Id)?
DelTargets = DelTarget (',' DelTarget)* ','?
DelTarget = TargetOne / P(MaybeDel) / S(MaybeDel)
MaybeDel = DelTargets?
Assignment = Id ':' Test ('=' (Yield / StarExprs))? / TargetOne ':' Test ('=' (Yield / StarExprs))? / P(TargetOne) ':' Test ('=' (Yield / StarExprs))? / (Targets '=')+ (Yield / StarExprs) !'=' / TargetOne AugOp (Yield / StarExprs) / P(TargetOne) AugOp (Yield / StarExprs)
AugOp = '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
Targets = StarTarget (',' StarTarget)* ','?
StarTarget = '*'? Target
Target = TargetOne / P(MaybeTargets) !Trailer / S(MaybeTargets) !Trailer
MaybeTargets = Targets?
TargetOne = Atom (Trailer &Trailer)* ('.' Id / S(Subscripts)) !Trailer / Id !Trailer
Compound = Decorator+ ('async'? Def / Class) / 'async' (Def / With / For) / Def / Class / If / While / For / Try / With / Match
Decorator = '@' NamedExpr NL
Def = 'def' Id P(Params) ('->' Test)? ':' FuncSuite
FuncSuite = Suite
Class = 'class' Id P(Args)? ':' Suite
If = 'if' NamedExpr ':' Suite ('elif' NamedExpr ':' Suite)* Else?
Else = 'else' ':' Suite
While = 'while' NamedExpr ':' Suite Else?
For = 'for' Targets 'in' StarExprs ':' Suite Else?
Try = 'try' ':' Suite (Except+ Else? Finally? / ExceptStar+ Else? Finally? / Finally)
Except = 'except' (Test ('as' Id)?)? ':' Suite
ExceptStar = 'except' '*' Test ('as' Id)? ':' Suite
Finally = 'finally' ':' Suite
With = 'with' (P(WithItems) ':' / WithItem (',' WithItem)* ':') Suite
WithItems = WithItem (',' WithItem)* ','?
WithItem = Test 'as' Target &(',' / ':' / END) / Test
Match = 'match' (NamedStar ',' NamedStars? / NamedExpr) ':' NL I(CaseBlocks)
CaseBlocks = ('case' Patterns ('if' NamedExpr)? ':' Suite)+
Patterns = OpenSeq / PatAs
OpenSeq = PatStar ',' (PatStar (',' PatStar)*)? ','?
PatStar = '*' Id / PatAs
PatAs = PatOr ('as' Id)?
PatOr = PatClosed ('|' PatClosed)*
PatClosed = '-'? NUM (('+' / '-') NUM)? / STR+ !BYTES / BYTES+ !STR / 'None' / 'True' / 'False' / Dotted P(PatArgs)? / P(PatGroup) / S(PatSeq) / B(PatMap)
PatGroup = OpenSeq / PatAs / &END
PatSeq = (PatStar (',' PatStar)* ','?)?
PatMap = ((PatPair (',' PatPair)* (',' '**' Id)? / '**' Id) ','?)?
PatPair = (Dotted / '-'? NUM (('+' / '-') NUM)? / STR+ / BYTES+ / 'None' / 'True' / 'False') ':' PatAs
PatArgs = ((PatAs !'=' (',' PatAs !'=')* (',' PatKw)* / PatKw (',' PatKw)*) ','?)?
PatKw = Id '=' PatAs
Params = (Plain (',' Plain)* (',' Defaulted)* ParamTail? / Defaulted (',' Defaulted)* ParamTail? / StarParams)? ','?
Plain = Id ParamAnn? !'='
Defaulted = Id ParamAnn? '=' Test
ParamAnn = ':' Test
StarAnn = ':' '*'? Test
ParamTail = ',' '/' ((',' Plain)* (',' Defaulted)* (',' StarParams)?) / ',' StarParams
StarParams = '*' Id StarAnn? (',' KwParam)* (',' DoubleStar)? / '*' (',' KwParam)+ (',' DoubleStar)? / DoubleStar
KwParam = Id ParamAnn? ('=' Test)?
DoubleStar = '**' Id ParamAnn?
LParams = LPlain (',' LPlain)* (',' LDefaulted)* LTail? ','? / LDefaulted (',' LDefaulted)* LTail? ','? / LStar ','?
LPlain = Id !'='
LDefaulted = Id '=' Test
LTail = ',' '/' ((',' LPlain)* (',' LDefaulted)* (',' LStar)?) / ',' LStar
LStar = '*' Id (',' LKw)* (',' '**' Id)? / '*' (',' LKw)+ (',' '**' Id)? / '**' Id
LKw = Id ('=' Test)?
StarExprs = StarExpr (',' StarExpr)* ','? / Yield
StarExpr = '*' BitOr / NamedlessTest
NamedlessTest = Test !':='
NamedStars = NamedStar (',' NamedStar)* ','?
NamedStar = '*' BitOr / NamedExpr
NamedExpr = Id ':=' Test / Test !':='
Yield = 'yield' ('from' Test / StarExprs)?
Test := 'lambda' LParams? ':' Test / OrTest ('if' OrTest 'else' Test)?
OrTest = NotTest (('or' / 'and') NotTest)*
NotTest = 'not'* Comparison
Comparison = BitOr (CompOp BitOr)*
CompOp = '==' / '!=' / '<=' / '>=' / '<' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
BitOr = Factor (('+' / '-' / '*' / '/' / '//' / '%' / '@' / '<<' / '>>' / '&' / '|' / '^' / '**') Factor)*
Factor = ('+' / '-' / '~')* 'await'? Atom Trailer*
Trailer = '.' Id / P(Args) / S(Subscripts)
Atom = Id / NUM / STR+ !BYTES / BYTES+ !STR / 'None' / 'True' / 'False' / '...' / P(Group) / S(ListBody) / B(DictOrSet)
Group = Yield / NamedStar CompFor &END / NamedStar (',' NamedStar)* ','? / &END
ListBody = NamedStar CompFor / (NamedStar (',' NamedStar)* ','?)?
DictOrSet = (DictItem CompFor / DictItem (',' DictItem)* ','?) &END / NamedStar CompFor / (NamedStar (',' NamedStar)* ','?)?
DictItem = '**' BitOr / Test ':' Test
CompFor = ('async'? 'for' Targets 'in' OrTest ('if' CompCond)*)+
CompCond = Id ':=' OrTest / OrTest
Subscripts = Subscript (',' Subscript)* ','?
Subscript = Test? ':' Test? (':' Test?)? / '*' BitOr / NamedExpr
Args = (NamedExpr CompFor &END / PosArgs)?
PosArgs = PosArg (',' PosArg)* (',' KwArgs)? ','? / KwArgs ','?
PosArg = '*' Test / Id ':=' Test / Test !('=' / ':=' / 'for' / 'async')
KwArgs = KwOrStar (',' KwOrStar)* (',' KwOrDouble)* / KwOrDouble (',' KwOrDouble)*
KwOrStar = Id '=' Test / '*' Test
KwOrDouble = Id '=' Test / '**' Test
"""
