"""Parsing-expression grammars of the languages, over the symbols of ``peg``.

Meaning, types and imports do not count; the grammars say what may follow what. Fixed
values: the keywords and operators of each language.
"""

OPERATORS = ">>>= ... <<= >>= >>> === !== **= &&= ||= ??= ?. => -> ++ -- && || ?? == != <= >= += -= *= /= %= &= |= ^= << ** :: := <- ..= .. = < > + - * / % & | ^ ! ~ ? : ; , . @ # $ \\ `"

JS_WORDS = "if else for while do return break continue switch case default try catch finally throw new delete typeof void in of instanceof function class extends import export from as async await yield let const var this super null true false static get set debugger with"
TS_WORDS = JS_WORDS + " interface type enum namespace declare readonly public private protected abstract implements keyof infer is satisfies override unique module"

_JS = """
Program <- %seq Stmt
Block <- %seq Stmt
Stmt <- ';' / AUTO / B.Block / Import / Export / Decl / If / For / While / DoWhile / Try / Switch / Jump / Label / ExprStmt
End <- ';' / AUTO / !ANY
Sep <- AUTO
Import <- 'import' TypeOnly? (STR / ImportWhat 'from' STR) End
ImportWhat <- '*' 'as' Name / Name (',' (B.Names / '*' 'as' Name))? / B.Names
Names <- (NameAs (',' NameAs)* ','?)?
NameAs <- TypeOnly? (WORD / STR) ('as' (WORD / STR))?
Export <- 'export' ('default' (Func / Class / Assign End) / '*' ('as' WORD)? 'from' STR End / TypeOnly? B.Names ('from' STR)? End / Decl)
Decl <- Func / Class / TypeDecl / VarDecl End
VarDecl <- ('const' / 'let' / 'var') Binding (',' Binding)*
Binding <- Target TypeAnn? ('=' Assign)?
Target <- Name / B.Object / S.Elems
Func <- 'async'? 'function' '*'? Name? TypeParams? P.Params TypeRet? (B.Block / Bodiless)
Class <- Decorator* Abstract? 'class' Name? TypeParams? ('extends' LeftSide TypeArgs?)? Implements? B.ClassBody
Decorator <- '@' Name ('.' WORD)* P.Args? Sep?
ClassBody <- %seq Member
Member <- ';' / AUTO / 'static' B.Block / Decorator* Modifier* (Method / Field)
Modifier <- ModWord &(WORD / STR / NUM / S.ExprAll / '*' / '#')
Method <- ('get' / 'set')? &Key '*'? Key '?'? TypeParams? P.Params TypeRet? (B.Block / Bodiless)
   / ('get' / 'set' / 'static') P.Params TypeRet? B.Block / '*' Key P.Params B.Block
Field <- Key ('?' / '!')? TypeAnn? ('=' Assign)? (End) / IndexSig End
Key <- '#'? WORD / STR / NUM / S.ExprAll
Params <- (Param (',' Param)* ','?)?
Param <- Decorator* ParamMod* '...'? (Target / 'this' &':') '?'? TypeAnn? ('=' Assign)?
If <- 'if' P.Expr Sep? Body (Sep? 'else' Sep? Body)?
Body <- Stmt
For <- 'for' 'await'? P.ForHead Sep? Body
ForHead <- (VarDecl / Expr)? ';' Expr? ';' Expr? / (('const' / 'let' / 'var') Target / LeftSide) ('of' / 'in') Expr
While <- 'while' P.Expr Sep? Body
DoWhile <- 'do' Stmt Sep? 'while' P.Expr End?
Try <- 'try' B.Block Sep? ('catch' P.Params? B.Block Sep? ('finally' B.Block)? / 'finally' B.Block)
Switch <- 'switch' P.Expr B.Cases
Cases <- Sep? (('case' Expr / 'default') ':' (!('case' / 'default' ':') Stmt)*)*
Jump <- ('return' Expr? / 'throw' Expr / ('break' / 'continue') Name? / 'debugger') End
Label <- ID ':' Stmt
ExprStmt <- !('function' / 'class') !B.Block Expr End
Expr <- Assign (',' Assign)*
ExprAll <- Expr
Assign <- Arrow / 'yield' '*'? Assign? / Cond (AssignOp Assign)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>>>=' / '**=' / '&&=' / '||=' / '??='
Arrow <- ('async' &(P.Params / Name '=>' / TypeParams))? (TypeParams? P.Params TypeRet? / Name) '=>' (B.Block / Assign)
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (BinOp Unary / AsType)*
BinOp <- '||' / '&&' / '??' / '|' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>'? / '<' / '>' / 'instanceof' / 'in' / '+' / '-' / '**' / '*' / '/' / '%'
Unary <- ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await') Unary / LeftSide ('++' / '--')?
LeftSide <- Primary Suffix*
Suffix <- '.' '#'? WORD / '?.' (WORD / P.Args / S.ExprAll) / P.Args / S.ExprAll / TPL / NonNull / TypeArgs &(P.Args / TPL)
Primary <- 'new' ('.' WORD / NewTarget TypeArgs? P.Args?) / Func / Class / 'import' &('.' / P.Args) / Name / NUM / STR / TPL / 'this' / 'super' / 'null' / 'true' / 'false' / P.Expr / S.Elems / B.Object
NewTarget <- ('new' NewTarget / Name / 'this' / P.Expr / Func / Class) ('.' WORD / S.ExprAll)*
Elems <- ','* (Elem (','+ Elem)* ','*)?
Elem <- '...'? Assign
Args <- (Elem (',' Elem)* ','?)?
Object <- (Prop (',' Prop)* ','?)?
Prop <- '...' Assign / 'async'? &(Key / '*') '*'? ('get' / 'set')? Key TypeParams? P.Params TypeRet? B.Block / ('get' / 'set' / 'async') P.Params B.Block / Key ':' Assign / Name ('=' Assign)?
Name <- ID / 'of' / 'from' / 'as' / 'get' / 'set' / 'static' / 'async' / 'let' !Name EXTRA
"""

JS = _JS.replace("EXTRA", "") + """
TypeOnly <- NEVER
TypeAnn <- NEVER
TypeRet <- NEVER
TypeParams <- NEVER
TypeArgs <- NEVER
TypeDecl <- NEVER
Implements <- NEVER
Bodiless <- NEVER
Abstract <- NEVER
ModWord <- 'static' / 'async' / 'get' / 'set'
ParamMod <- NEVER
IndexSig <- NEVER
NonNull <- NEVER
AsType <- NEVER
"""

TS = _JS.replace("EXTRA", "/ 'type' / 'namespace' / 'declare' / 'readonly' / 'abstract' / 'keyof' / 'infer' / 'is' / 'satisfies' / 'override' / 'unique' / 'module' / 'public' / 'private' / 'protected' / 'interface' !Name") + """
TypeOnly <- 'type' &(Name / B.Names / '*')
TypeAnn <- ':' Type
TypeRet <- ':' (Name 'is' Type / Type)
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- 'const'? Name ('extends' Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* '>'
TypeDecl <- 'declare'? ('interface' Name TypeParams? ('extends' Type (',' Type)*)? B.TypeBody / 'type' Name TypeParams? '=' Type End / 'const'? 'enum' Name B.EnumBody
   / ('namespace' / 'module') (Name ('.' WORD)* / STR) B.Block) / 'declare' (VarDecl End / Func / Class)
Implements <- 'implements' Type (',' Type)*
Bodiless <- End
Abstract <- 'declare'? 'abstract'
ModWord <- 'static' / 'async' / 'get' / 'set' / 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare'
ParamMod <- ('public' / 'private' / 'protected' / 'readonly' / 'override') &(Name / B.Object / S.Elems)
IndexSig <- S.IndexSigIn ':' Type
IndexSigIn <- Name ':' Type
NonNull <- '!' !'='
AsType <- ('as' / 'satisfies') Type
EnumBody <- (EnumItem (',' EnumItem)* ','?)?
EnumItem <- Key ('=' Assign)?
TypeBody <- (TypeMember (',' / ';' / AUTO)*)*
TypeMember <- ('readonly' / '+' / '-')* (S.IndexSigIn / S.MappedIn) ('+' / '-')? '?'? ':' Type / 'new'? TypeParams? P.Params TypeRet?
   / ('readonly' &Key)? ('get' / 'set')? &Key Key '?'? (TypeParams? P.Params TypeRet? / TypeAnn)?
MappedIn <- Name 'in' Type ('as' Type)?
Type <- ('|' / '&')? CondType
CondType <- Union ('extends' Union '?' Type ':' Type)?
Union <- TypePost (('|' / '&') TypePost)*
TypePost <- TypeAtom (S.Nothing / S.Type)*
Nothing <- !ANY
TypeAtom <- ('keyof' / 'unique' / 'readonly' / 'infer') TypeAtom / 'typeof' Name ('.' WORD)* / 'new'? TypeParams? P.Params '=>' Type / P.Type / B.TypeBody / S.TupleIn / STR / TPL / '-'? NUM
   / ('void' / 'null' / 'this' / 'true' / 'false') / Name ('.' WORD)* TypeArgs? / 'import' P.Args ('.' WORD)* TypeArgs?
TupleIn <- (TupleItem (',' TupleItem)* ','?)?
TupleItem <- '...'? (Name '?'? ':')? Type '?'?
"""

JAVA_WORDS = "abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while boolean byte char double float int long short null true false record sealed permits yield var"
JAVA = """
Program <- %seq Top
Top <- ';' / Package / Import / Member
Package <- Annotation* 'package' Path ';'
Import <- 'import' 'static'? Path ('.' '*')? ';'
Path <- Name ('.' Name)*
Name <- ID / 'record' / 'sealed' / 'permits' / 'yield' / 'var'
Annotation <- '@' !'interface' Path P.Pairs?
Pairs <- (Pair (',' Pair)*)?
Pair <- (Name '=')? (Annotation / B.Values / Expr)
Mod <- Annotation / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !':' / 'sealed' &(Mod / 'class' / 'interface') / ID '-' 'sealed'
ClassBody <- %seq Member
Member <- ';' / Mod* (TypeDecl / Ctor / Method / Field / B.Block)
TypeDecl <- 'class' Name TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? B.ClassBody
   / 'interface' Name TypeParams? ('extends' Types)? ('permits' Types)? B.ClassBody / '@' 'interface' Name B.ClassBody
   / 'enum' Name ('implements' Types)? B.EnumBody / 'record' Name TypeParams? P.Params ('implements' Types)? B.ClassBody
EnumBody <- (Constant (',' Constant)*)? ','? (';' Member*)?
Constant <- Annotation* Name P.Args? B.ClassBody?
Ctor <- TypeParams? Name P.Params? ('throws' Types)? B.Block
Method <- TypeParams? Type Name P.Params S.Nothing* ('throws' Types)? (B.Block / ('default' (B.Values / Expr))? ';')
Field <- Type Vars ';'
Vars <- Var (',' Var)*
Var <- Name S.Nothing* ('=' (B.Values / Expr))?
Values <- (Value (',' Value)* ','?)?
Value <- B.Values / Annotation / Expr
Params <- (Param (',' Param)*)?
Param <- Mod* Type Annotation* '...'? (Name S.Nothing* / (Name '.')* 'this')
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annotation* Name ('extends' Type ('&' Type)*)?
Types <- Type (',' Type)*
Type <- Annotation* (Primitive / Path TypeArgs? ('.' Path TypeArgs?)*) (Annotation* S.Nothing)*
Primitive <- 'boolean' / 'byte' / 'char' / 'double' / 'float' / 'int' / 'long' / 'short' / 'void'
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- '?' (('extends' / 'super') Type)? / Type
Nothing <- !ANY
Block <- %seq Stmt
Stmt <- ';' / B.Block / If / For / 'while' P.Expr Stmt / 'do' Stmt 'while' P.Expr ';' / Try / Switch ';'? / 'synchronized' P.Expr B.Block / Jump / Name ':' Stmt / Mod* TypeDecl / Local ';' / Expr ';'
If <- 'if' P.Expr Stmt ('else' Stmt)?
For <- 'for' P.ForHead Stmt
ForHead <- Mod* Type Name ':' Expr / (Local / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)?
Local <- Mod* Type Vars
Try <- 'try' P.Resources? B.Block ('catch' P.Caught B.Block)* ('finally' B.Block)?
Resources <- Resource (';' Resource)* ';'?
Resource <- Mod* Type Name '=' Expr / Expr
Caught <- Mod* Type ('|' Type)* Name
Switch <- 'switch' P.Expr B.Cases
Cases <- (('case' Label (',' Label)* / 'default') (':' Stmt* / '->' ('throw' Expr ';' / B.Block / Expr ';')))*
Label <- 'default' / Mod* Type Name / Ternary
Jump <- ('return' Expr? / 'throw' Expr / ('break' / 'continue') Name? / 'assert' Expr (':' Expr)? / 'yield' !('=' / '.') Expr) ';'
Expr <- Lambda / Ternary (AssignOp Expr)?
Lambda <- (Name / P.Params / P.Idents) '->' (B.Block / Expr)
Idents <- (Name (',' Name)*)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>'? '='  / '>' '>='
Ternary <- Binary ('?' Expr ':' Expr)?
Binary <- Unary (BinOp Unary / 'instanceof' 'final'? Type Name? P.Patterns?)*
Patterns <- (Mod* Type Name? (',' Mod* Type Name?)*)?
BinOp <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' '>'? / '<' / '>' / '+' / '-' / '*' / '/' / '%'
Unary <- ('!' / '~' / '+' / '-' / '++' / '--') Unary / P.CastTo Unary / Postfix
CastTo <- Type ('&' Type)*
Postfix <- Primary Suffix* ('++' / '--')*
Suffix <- '.' (TypeArgs? Name P.Args? / 'class' / 'this' / 'super' / 'new' Creator) / S.Expr / '::' TypeArgs? (Name / 'new')
Primary <- 'new' Creator / Switch / Literal / ('this' / 'super') P.Args? / P.Expr / Name P.Args? / Type ('.' 'class' / '::' ('new' / Name))
Literal <- NUM / STR / 'null' / 'true' / 'false'
Creator <- Annotation* (Primitive / Path TypeArgs? ('.' Path TypeArgs?)*) (P.Args B.ClassBody? / (S.Nothing / S.Expr)+ B.Values?)
Args <- (Expr (',' Expr)*)?
"""

C_WORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Static_assert _Alignas _Noreturn _Atomic _Thread_local"
CPP_WORDS = C_WORDS + " class namespace template typename using public private protected virtual override final new delete this nullptr true false bool operator friend explicit constexpr consteval constinit noexcept decltype static_cast dynamic_cast const_cast reinterpret_cast throw try catch mutable static_assert wchar_t char8_t char16_t char32_t typeid co_await co_return co_yield concept requires alignas alignof thread_local export default"
_C = """
Program <- %seq Top
Top <- ';' / Extra / Function / Declaration
Function <- Attr* Specs Pointer* (DeclName / P.Declarator) P.Params (P.Params / S.MaybeExpr)* Trailer? B.Block
Attr <- S.AttrIn
AttrIn <- S.Anything
Anything <- ANY*
Specs <- (Storage / Qual)* TypeSpec (Storage / Qual)*
Storage <- 'typedef' / 'extern' STR? / 'static' / 'register' / 'inline' / '_Noreturn' / '_Thread_local' / MoreStorage
Qual <- 'const' / 'volatile' / 'restrict' / '_Atomic'
TypeSpec <- Basic (Qual? Basic)* / ('struct' / 'union') Attr* Tag / 'enum' Tag2 / NamedType
Basic <- 'void' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double' / 'signed' / 'unsigned' / '_Bool' / MoreBasic
Tag <- ID? B.Fields / ID
Tag2 <- MoreEnum? ID? (':' Specs)? B.Enums / MoreEnum? ID
Fields <- (Field / ';')*
Field <- Specs (FieldDecl (',' FieldDecl)*)? ';'
FieldDecl <- Declarator (':' Cond)? / ':' Cond
Enums <- (ID ('=' Cond)? (',' ID ('=' Cond)?)* ','?)?
Declarator <- Pointer* Direct
Pointer <- ('*' / Ref) Qual*
Direct <- (DeclName / P.Declarator) (P.Params / S.MaybeExpr)*
AbstractDecl <- Pointer* (P.AbstractDecl)? (P.Params / S.MaybeExpr)*
MaybeExpr <- ('static' / Qual)* Expr?
Params <- (Param (',' Param)* (',' '...')? / '...')?
Param <- Attr* Specs (Declarator / AbstractDecl) Default?
Declaration <- Attr* Specs (InitDecl (',' InitDecl)*)? ';'
InitDecl <- Declarator Trailer? Init?
Block <- %seq Stmt
Stmt <- ';' / B.Block / If / Switch / 'while' P.CondDecl Stmt / 'do' Stmt 'while' P.Expr ';' / 'for' P.ForHead Stmt / Jump / ID ':' Stmt? / CaseLabel / ExtraStmt / Expr ';' / Declaration
If <- 'if' MoreIf? P.CondDecl Stmt ('else' Stmt)?
CondDecl <- Specs Declarator Init / (Declaration)? Expr
Switch <- 'switch' P.CondDecl Stmt
CaseLabel <- ('case' Cond ('...' Cond)? / 'default') ':' Stmt?
ForHead <- MoreFor / (Declaration / Expr? ';') Expr? ';' Expr?
Jump <- ('return' (Expr / BraceInit)? / 'break' / 'continue' / 'goto' ID) ';'
Expr <- Assign (',' Assign)*
Assign <- MoreAssign / Cond (AssignOp (Assign / BraceInit))?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>=' / '>>='
Cond <- Binary ('?' Expr ':' Assign)?
Binary <- Unary (BinOp Unary)*
BinOp <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / MoreBin
Unary <- ('!' / '~' / '+' / '-' / '++' / '--' / '*' / '&' / '&&') Unary / 'sizeof' (P.TypeName / '...'? Unary) / P.TypeName (Unary / B.Inits) / MoreUnary / Postfix
TypeName <- Specs AbstractDecl
Postfix <- Primary Suffix*
Suffix <- S.Subscript / P.Args / ('.' / '->') Member / '++' / '--' / MoreSuffix
Subscript <- Expr / BraceInit
BraceInit <- B.Inits
Inits <- (InitItem (',' InitItem)* ','?)?
InitItem <- (('.' ID / S.Expr)+ '=')? (B.Inits / Assign) '...'?
"""
C = _C + """
Extra <- '_Static_assert' P.Args ';'
ExtraStmt <- Extra
Trailer <- NEVER
MoreStorage <- NEVER
MoreBasic <- NEVER
MoreEnum <- NEVER
Ref <- NEVER
NamedType <- 'auto' / ID &(ID / '*' / Qual / P.Declarator / ',' / !ANY / ':')
DeclName <- ID
Default <- NEVER
Init <- '=' (B.Inits / Assign)
MoreIf <- NEVER
MoreFor <- NEVER
MoreAssign <- NEVER
MoreBin <- NEVER
MoreUnary <- NEVER
MoreSuffix <- NEVER
Member <- ID
Args <- (Arg (',' Arg)*)?
Arg <- Assign / TypeName
Primary <- ID / NUM / STR+ / P.Expr / P.StmtExpr
StmtExpr <- B.Block
"""
CPP = _C.replace("Fields <- (Field / ';')*", "Fields <- %seq Field").replace("Tag <- ID? B.Fields / ID", "Tag <- Attr* (Qualified 'final'? Bases? B.Fields / B.Fields / Qualified)").replace(
    "Field <- Specs (FieldDecl (',' FieldDecl)*)? ';'", "Field <- ';' / ('public' / 'private' / 'protected') ':' / Extra / Ctor / Function / Attr* Specs (FieldDecl (',' FieldDecl)*)? ';'"
).replace("FieldDecl <- Declarator (':' Cond)?", "FieldDecl <- Declarator Trailer? (':' Cond)? (Init / '=' 'default')?") + """
Extra <- 'namespace' Attr* Qualified? B.Program / 'extern' STR B.Program / 'template' TemplateParams Requires? Extra2 / 'using' 'namespace' Qualified ';' / 'using' Qualified ('=' TypeName)? ';' / 'using' 'enum' Qualified ';'
   / 'static_assert' P.Args ';' / Ctor / 'inline' 'namespace' ID B.Program / 'friend' (Function / Declaration)
Extra2 <- Extra / 'concept' ID '=' Expr ';' / Function / Declaration
Requires <- 'requires' Cond
Ctor <- Attr* ('explicit' P.Expr? / 'inline' / 'constexpr' / 'virtual')* (Qualified '::')? '~'? Qualified P.Params Trailer? (':' MemInit (',' MemInit)*)? (B.Block / '=' ('default' / 'delete' / NUM) ';' / ';')
   / ('explicit' / 'inline' / 'constexpr' / 'virtual')* (Qualified '::')? 'operator' Specs Pointer* P.Params Trailer? (B.Block / ';')
MemInit <- Qualified (P.Args / B.Inits) '...'?
ExtraStmt <- Try / 'using' Qualified ('=' TypeName)? ';' / 'using' 'namespace' Qualified ';' / 'throw' Expr? ';' / 'static_assert' P.Args ';' / ('co_return' Expr? / 'co_yield' Expr) ';'
Try <- 'try' B.Block ('catch' P.Caught B.Block)+
Caught <- '...' / Param
Bases <- ':' Base (',' Base)*
Base <- ('public' / 'private' / 'protected' / 'virtual')* Qualified '...'?
TemplateParams <- '<' (TParam (',' TParam)*)? '>'
TParam <- ('typename' / 'class') '...'? ID? ('=' TypeName)? / 'template' TemplateParams ('class' / 'typename') ID? / Specs '...'? (Declarator / AbstractDecl) ('=' Shift)?
Shift <- Unary (('+' / '-' / '*' / '/' / '==' / '&&' / '||') Unary)*
Trailer <- ('const' / 'volatile' / 'override' / 'final' / 'noexcept' P.Expr? / '&' / '&&' / '->' TypeName / Attr / 'try' / Requires)+ (':' MemInit (',' MemInit)*)?
MoreStorage <- 'constexpr' / 'consteval' / 'constinit' / 'virtual' / 'explicit' / 'friend' / 'mutable' / 'thread_local' / 'alignas' P.Args
MoreBasic <- 'bool' / 'wchar_t' / 'char8_t' / 'char16_t' / 'char32_t' / 'decltype' P.Args
MoreEnum <- 'class' / 'struct'
Ref <- '&&' / '&' / Qualified '::' '*'
NamedType <- 'class' Tag / 'typename' Qualified / 'auto' / Qualified &(ID / '*' / '&' / '&&' / Qual / P.Declarator / ',' / '>' / !ANY / S.Idents / ':' / '...' / 'operator' / '=' / B.Inits / '~')
Qualified <- '::'? QName ('::' 'template'? QName)*
QName <- '~'? ID TemplateArgs?
TemplateArgs <- '<' (TArg (',' TArg)*)? '>'
TArg <- TypeName '...'? &(',' / '>') / Shift
DeclName <- (Qualified '::')? 'operator' OpName / S.Idents / Qualified
Idents <- ID (',' ID)*
OpName <- P.Nothing / S.Nothing / ('new' / 'delete') S.Nothing? / '>' '>' '='? / '<<' / '<<=' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '+' / '-' / '*' / '/' / '%' / '&&' / '||' / '&' / '|' / '^' / '!' / '~' / '++' / '--' / '->' / ',' / STR ID?
Nothing <- !ANY
Default <- '=' (BraceInit / Assign)
Init <- '=' (B.Inits / 'default' / 'delete' / Assign) / B.Inits / P.Args
MoreIf <- 'constexpr'
MoreFor <- Declaration? Attr* Specs (Pointer* (ID / S.Idents)) ':' (Expr / B.Inits)
MoreAssign <- 'throw' Assign?
MoreBin <- '<=' '>' / '.' '*' / '->' '*'
MoreUnary <- ('co_await') Unary / 'new' P.Args? TypeName (P.Args / B.Inits)? / '::'? 'delete' S.Nothing? Unary / 'noexcept' P.Expr / 'alignof' P.TypeName
MoreSuffix <- B.Inits / '...'
Member <- 'template'? ('~'? Qualified / 'operator' OpName)
Args <- (Arg (',' Arg)*)?
Arg <- B.Inits / Assign '...'? / TypeName
Primary <- ('static_cast' / 'dynamic_cast' / 'const_cast' / 'reinterpret_cast') '<' TypeName '>' P.Expr / 'typeid' P.Args / Lambda / Qualified / Basic (P.Args / B.Inits) / 'this' / 'nullptr' / 'true' / 'false' / NUM ID? / (STR ID?)+ / P.Expr / P.StmtExpr / P.Fold / 'requires' P.Params? B.Anything / 'typename' Qualified (P.Args / B.Inits)
Fold <- ('...' BinOp Unary / Unary BinOp '...' (BinOp Unary)?)
StmtExpr <- B.Block
Lambda <- S.Captures TemplateParams? P.Params? ('mutable' / 'constexpr' / 'noexcept')* ('->' TypeName)? B.Block
Captures <- (Capture (',' Capture)*)?
Capture <- '=' / '&' / '*'? 'this' / '&'? '...'? ID '...'? ('=' Assign)?
"""

GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO = """
Program <- %seq Top
Top <- ';' / 'package' ID End / 'import' (ImportSpec / P.Imports) End / Decl / FuncDecl
End <- ';' / !ANY
Imports <- (ImportSpec? (';' ImportSpec?)*)
ImportSpec <- (ID / '.')? STR
Decl <- 'const' (ConstSpec / P.Consts) End / 'var' (VarSpec / P.Vars) End / 'type' (TypeSpec / P.Types) End
Consts <- (ConstSpec? (';' ConstSpec?)*)
ConstSpec <- Idents (Type? '=' Exprs)?
Vars <- (VarSpec? (';' VarSpec?)*)
VarSpec <- Idents (Type ('=' Exprs)? / '=' Exprs)
Types <- (TypeSpec? (';' TypeSpec?)*)
TypeSpec <- ID S.TypeParams? '='? Type
TypeParams <- TypeParam (',' TypeParam)* ','?
TypeParam <- Idents Constraint
Constraint <- '~'? Type ('|' '~'? Type)*
Idents <- ID (',' ID)*
FuncDecl <- 'func' P.Params? ID S.TypeParams? P.Params Result? (B.Block End / End)
Result <- P.Params / Type
Params <- (Param (',' Param)* ','?)?
Param <- ID '...'? Type / '...'? Type
Type <- '*' Type / S.Nothing Type / S.ArrayLen Type / 'map' S.Type Type / '<-' 'chan' Type / 'chan' '<-'? Type / 'func' P.Params Result? / 'struct' B.Fields / 'interface' B.Methods / P.Type / ID ('.' ID)? S.TypeArgs?
TypeArgs <- Type (',' Type)*
ArrayLen <- '...' / Expr
Nothing <- !ANY
Fields <- (Field? (';' Field?)*)
Field <- (Idents Type / '*'? ID ('.' ID)? S.TypeArgs?) STR?
Methods <- (Method? (';' Method?)*)
Method <- ID P.Params Result? / Constraint
Block <- %seq Stmt
Stmt <- ';' / Decl / Label / (Simple0 / Control / SimpleStmt) End
Label <- ID ':' Stmt?
Simple0 <- 'return' Exprs? / ('break' / 'continue') ID? / 'goto' ID / 'fallthrough' / ('go' / 'defer') Expr
Control <- B.Block / If / For / Switch / Select
If <- 'if' Head B.Block ('else' (If / B.Block))?
Head <- (SimpleStmt? ';')? CondExpr
For <- 'for' (ForHead)? B.Block
ForHead <- (CondLhs (':=' / '='))? 'range' CondExpr / CondSimple? ';' CondExpr? ';' CondSimple? / CondExpr
CondLhs <- Exprs
CondSimple <- CondSimpleIn
CondSimpleIn <- NoLits ((':=' / AssignOp) NoLits / '++' / '--' / '<-' NoLit)?
Switch <- 'switch' (SimpleStmt? ';')? (ID ':=' NoLit '.' P.TypeWord / NoLit ((':=' / AssignOp) NoLits)?)? B.Cases
TypeWord <- 'type'
Cases <- ';'* (('case' TypeOrExprs / 'default') ':' (!('case' / 'default') Stmt)*)*
TypeOrExprs <- TypeOrExpr (',' TypeOrExpr)*
TypeOrExpr <- Expr &(',' / ':') / Type
Select <- 'select' B.Comms
Comms <- ';'* (('case' SimpleStmt / 'default') ':' (!('case' / 'default') Stmt)*)*
SimpleStmt <- Exprs ((':=' / AssignOp) Exprs / '++' / '--' / '<-' Expr)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>' '>='
Exprs <- Expr (',' Expr)*
Expr <- Unary (BinOp Unary)*
CondExpr <- NoLit
NoLits <- NoLit (',' NoLit)*
NoLit <- UnaryN (BinOp UnaryN)*
BinOp <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '&' '^'? / '<-'
Unary <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-' / '~') Unary / Operand Suffix*
UnaryN <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-') UnaryN / OperandN SuffixN*
Suffix <- SuffixN
SuffixN <- '.' (ID / P.TypeWord / P.Type) / S.Index / P.Args
Index <- Expr? (':' Expr?)* / Type (',' Type)*
LitBody <- B.Elems
Elems <- (Elem (',' Elem)* ','?)?
Elem <- ((B.Elems / Expr) ':')? (B.Elems / Expr)
Args <- (Arg (',' Arg)* '...'? ','?)?
Arg <- Expr / Type
Operand <- CompType LitBody / OperandN
CompType <- S.Nothing Type / S.ArrayLen Type / 'map' S.Type Type / 'struct' B.Fields / ID ('.' ID)? S.TypeArgs?
OperandN <- NUM / STR / TPL / FuncLit / S.Nothing Type (P.Args / LitBody) / 'map' S.Type Type (P.Args / LitBody) / 'chan' Type / 'struct' B.Fields LitBody / 'interface' B.Methods P.Args / ID / P.Expr / P.Type P.Args
FuncLit <- 'func' P.Params Result? B.Block
"""

RUST_WORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union"
RUST = """
Program <- %seq Item
Item <- Attr / ';' / Vis? Decl
Attr <- '#' '!'? S.Anything
Anything <- ANY*
Vis <- 'pub' P.Anything?
Decl <- Use / Mod / Fn / Struct / Enum / Trait / Impl / Const / TypeAlias / MacroDef / MacroItem / 'extern' 'crate' ID ('as' ID)? ';' / 'extern' STR? B.Items
Items <- %seq Item
Use <- 'use' UseTree ';'
UseTree <- '::'? ((PathWord '::')* (B.UseList / '*' / PathWord ('as' ID)?))
UseList <- (UseTree (',' UseTree)* ','?)?
PathWord <- ID / 'crate' / 'self' / 'super' / 'Self' / 'union'
Mod <- 'unsafe'? 'mod' ID (';' / B.Items)
Fn <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' ID Generics? P.Params ('->' Type)? Where? (B.Block / ';')
Generics <- '<' (GParam (',' GParam)* ','?)? '>'
GParam <- TPL (':' TPL ('+' TPL)*)? / 'const' ID ':' Type ('=' Simple)? / ID (':' Bounds?)? ('=' Type)?
Simple <- NUM / STR / ID / B.Block / 'true' / 'false'
Bounds <- Bound ('+' Bound)* '+'?
Bound <- TPL / '?'? P.Type / '?'? ForAll? Path
ForAll <- 'for' Generics
Where <- 'where' (WhereOne (',' WhereOne)* ','?)?
WhereOne <- TPL ':' TPL / ForAll? Type ':' Bounds?
Params <- (Param (',' Param)* ','?)?
Param <- Attr* ('&' TPL? 'mut'? 'self' / 'mut'? 'self' (':' Type)? / Pattern ':' Type / '...')
Struct <- ('struct' / 'union') ID Generics? (Where? B.Fields / P.TupleFields Where? ';' / ';')
Fields <- (Field (',' Field)* ','?)?
Field <- Attr* Vis? ID ':' Type
TupleFields <- (Attr* Vis? Type (',' Attr* Vis? Type)* ','?)?
Enum <- 'enum' ID Generics? Where? B.Variants
Variants <- (Variant (',' Variant)* ','?)?
Variant <- Attr* Vis? ID (P.TupleFields / B.Fields)? ('=' Expr)?
Trait <- 'unsafe'? 'trait' ID Generics? (':' Bounds?)? Where? B.Items
Impl <- 'unsafe'? 'impl' (Generics &Type)? (ImplTarget 'for')? Type Where? B.Items
ImplTarget <- '!'? Type
Const <- ('const' / 'static' 'mut'?) ID ':' Type ('=' Expr)? ';'
TypeAlias <- 'type' ID Generics? (':' Bounds)? Where? ('=' Type)? ';'
MacroDef <- ID '!' ID (B.Anything / P.Anything ';')
MacroItem <- PathOnly '!' (B.Anything / (P.Anything / S.Anything) ';')
PathOnly <- '::'? PathWord ('::' PathWord)*
Type <- TypeOne ('+' Bound)*
TypeOne <- ('&' / '&&') TPL? 'mut'? TypeOne / '*' ('const' / 'mut') TypeOne / S.ArrayType / P.Types / '!' / 'dyn' Bounds / 'impl' Bounds / ForAll? ('unsafe' / 'extern' STR?)* 'fn' P.FnTypes ('->' TypeOne)? / '<' Type ('as' Path)? '>' ('::' Segment)+ / Path ('!' P.Anything)?
ArrayType <- Type (';' Expr)?
Types <- (Type (',' Type)* ','?)?
FnTypes <- ((ID ':')? Type (',' (ID ':')? Type)* ','?)?
Path <- '::'? Segment ('::' Segment)*
Segment <- PathWord ('::'? GArgs / P.Types ('->' TypeOne)?)?
GArgs <- '<' (GArg (',' GArg)* ','?)? '>'
GArg <- TPL / ID GArgs? '=' Type / ID ':' Bounds / Type / '-'? NUM / STR / B.Block / 'true' / 'false'
Block <- %seq Stmt
Stmt <- ';' / Attr / Let / Item2 / BlockExpr !('.' / '?') (';')? / Expr (';' / !ANY)
Item2 <- !('const' B.Block / 'unsafe' B.Block / 'async' ('move')? B.Block) !(MacroItem) Vis? Decl
Let <- 'let' Pattern (':' Type)? ('=' Expr ('else' B.Block)?)? ';'
BlockExpr <- (TPL ':')? (If / Match / 'loop' B.Block / 'while' Cond B.Block / 'for' Pattern 'in' NoStruct B.Block / ('unsafe' / 'const')? B.Block)
If <- 'if' Cond B.Block ('else' (If / B.Block))?
Cond <- CondOne ('&&' CondOne)*
CondOne <- 'let' Pattern '=' NoStructSimple / NoStruct
Match <- 'match' NoStruct B.Arms
Arms <- (Attr* '|'? Pattern ('if' Cond2)? '=>' (BlockExpr ','? / Expr (',' / !ANY)))*
Cond2 <- CondB ('&&' CondB)*
CondB <- 'let' Pattern '=' Expr / Expr
Pattern <- '|'? PatOne ('|' PatOne)*
PatOne <- PatRange / PatSimple
PatRange <- PatLit? ('..=' / '...' / '..') PatLit? / PatLit
PatLit <- '-'? NUM / STR / Path !(P.Patterns / B.PatFields / '@' / '!')
PatSimple <- ('&' / '&&') 'mut'? PatOne / 'ref'? 'mut'? ID '@' PatOne / 'ref'? 'mut'? ID !('::' / P.Patterns / B.PatFields / '!' / '<') / P.Patterns / S.Patterns / Path (P.Patterns / B.PatFields)? / PathOnly '!' (P.Anything / S.Anything)
Patterns <- (Pattern (',' Pattern)* ','?)?
PatFields <- (PatField (',' PatField)* ','?)?
PatField <- '..' / (ID / NUM) ':' Pattern / 'ref'? 'mut'? ID
Expr <- Assign
Assign <- Range (AssignOp Assign)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>='
Range <- ('..=' / '..') Or? / Or (('..=' / '..') Or?)?
Or <- Unary (BinOp Unary / 'as' TypeOne)*
BinOp <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' / '<' / '>' / '|' / '^' / '&' / '+' / '-' / '*' / '/' / '%'
Unary <- ('-' / '!' / '*' / ('&' / '&&') ('mut' / ID &('const' / 'mut') ANY)?) Unary / Closure / Jump / Primary Suffix*
Suffix <- '?' / '.' ('await' / ID ('::' GArgs)? P.Args? / NUM) / P.Args / S.Expr
Closure <- 'static'? 'async'? 'move'? ('||' / '|' (CParam (',' CParam)* ','?)? '|') ('->' TypeOne B.Block / Expr)
CParam <- Attr* PatOne (':' Type)?
Jump <- 'return' Expr? / 'break' TPL? Expr? / 'continue' TPL?
Args <- (Expr (',' Expr)* ','?)?
Primary <- BlockExpr / 'async' 'move'? B.Block / PathOnly '!' (P.Anything / S.Anything / B.Anything) / StructLit / NUM / STR / 'true' / 'false' / P.Args / S.Array / EPath / '<' Type ('as' Path)? '>' ('::' ESeg)+
StructLit <- EPath B.Inits
Inits <- (Init (',' Init)* ','?)?
Init <- Attr* ('..' Expr? / (ID / NUM) ':' Expr / ID)
Array <- Expr ';' Expr / Args
EPath <- '::'? ESeg ('::' ESeg)*
ESeg <- PathWord ('::' GArgs)?
NoStruct <- NAssign
NoStructSimple <- NUnary (NBin NUnary / 'as' TypeOne)*
NBin <- !('&&' / '||') BinOp
NAssign <- NRange (AssignOp NAssign)?
NRange <- ('..=' / '..') NOr? / NOr (('..=' / '..') NOr?)?
NOr <- NUnary (BinOp NUnary / 'as' TypeOne)*
NUnary <- ('-' / '!' / '*' / ('&' / '&&') 'mut'?) NUnary / Closure / Jump / NPrimary Suffix*
NPrimary <- BlockExpr / PathOnly '!' (P.Anything / S.Anything) / NUM / STR / 'true' / 'false' / P.Args / S.Array / EPath
"""

PY_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
PYTHON = """
Simple <- Small (';' Small)* ';'?
Small <- 'pass' / 'break' / 'continue' / 'return' Star? / 'raise' (Test ('from' Test)?)? / ('global' / 'nonlocal') ID (',' ID)* / 'del' Star / 'assert' Test (',' Test)? / Import / TypeStmt / ExprStmt
TypeStmt <- 'type' ID S.Anything? '=' Test
Anything <- ANY*
Import <- 'import' DotAs (',' DotAs)* / 'from' ('.' / '...')* Dotted? 'import' ('*' / P.ImportList / ImportNames)
DotAs <- Dotted ('as' ID)?
Dotted <- ID ('.' ID)*
ImportList <- ImportNames ','?
ImportNames <- ID ('as' ID)? (',' ID ('as' ID)?)*
ExprStmt <- Star (':' Test ('=' Value)? / AugOp Value / ('=' Value)*)
AugOp <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
Value <- Yield / Star
Yield <- 'yield' ('from' Test / Star)?
Star <- StarItem (',' StarItem)* ','?
StarItem <- '*' Or / Named
Named <- ID ':=' Test / Test
Test <- Lambda / OrTest ('if' OrTest 'else' Test)?
Lambda <- 'lambda' LParams? ':' Test
LParams <- LParam (',' LParam)* ','?
LParam <- '**' ID / '*' ID? / '/' / ID ('=' Test)?
OrTest <- AndTest ('or' AndTest)*
AndTest <- NotTest ('and' NotTest)*
NotTest <- 'not' NotTest / Comp
Comp <- Or (CompOp Or)*
CompOp <- '<=' / '>=' / '==' / '!=' / '<' / '>' / 'in' / 'not' 'in' / 'is' 'not'?
Or <- Factor (('|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '**' / '*' / '//' / '/' / '%' / '@') Factor)*
Factor <- ('+' / '-' / '~' / 'await') Factor / Atom Trailer*
Trailer <- '.' ID / P.Args / S.Subs
Atom <- ID / NUM / STR+ / 'None' / 'True' / 'False' / '...' / P.Inner / S.List / B.Dict / 'lambda' NEVER
Inner <- Yield / Comprehension / Star / Nothing
Nothing <- !ANY
List <- Comprehension / Star / Nothing
Comprehension <- StarItem CompFor
CompFor <- 'async'? 'for' Targets 'in' OrTest ('if' OrNoCond)* CompFor?
OrNoCond <- ID ':=' Test / Lambda / OrTest
Targets <- ('*'? Or) (',' '*'? Or)* ','?
Dict <- Nothing / DictItem CompFor / DictItem (',' DictItem)* ','? / Comprehension / Star
DictItem <- '**' Or / Test ':' Test
Args <- (Arg (',' Arg)* ','?)?
Arg <- '**' Test / '*' Test / ID '=' Test / Named CompFor?
Subs <- Sub (',' Sub)* ','?
Sub <- Test? ':' Test? (':' Test?)? / '*' Or / Named
Params <- (PParam (',' PParam)* ','?)?
PParam <- '**' ID (':' Test)? / '*' (ID (':' StarItem)?)? / '/' / ID (':' Test)? ('=' Test)?
IfHead <- 'if' Named
ElifHead <- 'elif' Named
ElseHead <- 'else'
WhileHead <- 'while' Named
ForHead <- 'async'? 'for' Targets 'in' Star
TryHead <- 'try'
ExceptHead <- 'except' '*'? (Test ('as' ID)? (',' Test)*)?
FinallyHead <- 'finally'
WithHead <- 'async'? 'with' (P.WithItems / WithItems)
WithItems <- WithItem (',' WithItem)* ','?
WithItem <- Test ('as' Or)?
DefHead <- 'async'? 'def' ID S.Anything? P.Params ('->' Test)?
ClassHead <- 'class' ID S.Anything? P.Args?
MatchHead <- 'match' Star
CaseHead <- 'case' Patterns ('if' Named)?
Patterns <- PatItem (',' PatItem)+ ','? / PatItem ',' / PatAs
PatItem <- '*' ID / PatAs
PatAs <- PatOr ('as' ID)?
PatOr <- PatOne ('|' PatOne)*
PatOne <- PatLit / Dotted P.PatArgs / Dotted / S.PatSeq / P.PatParen / B.PatMap
PatLit <- '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False'
PatParen <- Patterns / Nothing
PatSeq <- (PatItem (',' PatItem)* ','?)?
PatArgs <- (PatArg (',' PatArg)* ','?)?
PatArg <- ID '=' PatAs / PatAs
PatMap <- (PatPair (',' PatPair)* ','?)?
PatPair <- '**' ID / (PatLit / Dotted) ':' PatAs
Decorator <- '@' Named
"""
PY_OPERATORS = "**= //= >>= <<= ... := -> ** // >> << <= >= == != += -= *= /= %= @= &= |= ^= = < > + - * / % & | ^ ~ : ; , . @ ! ? $ \\ `"
#: What the parts of a Python block may be: kinds of lines and their blocks.
PY_BLOCKS = """
Block <- Part+
Part <- 'x' / 'I' Suite ('E' Suite)* ('L' Suite)? / ('F' / 'W') Suite ('L' Suite)? / 'T' Suite (('X' Suite)+ ('L' Suite)? ('Y' Suite)? / 'Y' Suite) / 'H' Suite / '@' Deco / 'D' Suite / 'M' B.Cases
Deco <- '@' Deco / 'D' Suite
Suite <- B.Block / 'o'
Cases <- ('C' Suite)+
"""
