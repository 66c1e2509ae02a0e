"""Facts that each extractor must yield from small sources."""

import pytest

from graphloom.sources.parsers import columns_of, parse_files, parse_text, references_of, symbols_of


def facts(language, text, path="src/file.x"):
    f = parse_text(path, language, text)
    symbols = {(s["kind"], s["qualified_name"]) for s in f.symbols}
    refs = {(r["reference_type"], r["from_symbol"], r["to_qualified"] or r["to_name"]) for r in f.refs}
    columns = {(c["source_column"], c["target_column"], c["derivation_type"]) for c in f.columns}
    return symbols, refs, columns


def test_tsql_table():
    s, _, _ = facts("tsql", "CREATE TABLE dbo.Users (\n Id INT IDENTITY(1,1) PRIMARY KEY,\n [Name] NVARCHAR(50) NOT NULL,\n Balance DECIMAL(10, 2) DEFAULT (0),\n Created DATETIME,\n CONSTRAINT PK_U UNIQUE (Id, Name)\n)\nGO\n")
    assert ("table", "dbo.Users") in s
    assert {q for k, q in s if k == "column"} == {"dbo.Users.Id", "dbo.Users.Name", "dbo.Users.Balance", "dbo.Users.Created"}


def test_tsql_procedure():
    s, r, _ = facts("tsql", """CREATE OR ALTER PROCEDURE dbo.GetUserOrders @UserId INT, @Since DATE AS
BEGIN
  -- FROM comment
  SELECT o.Id, o.Total FROM Orders o INNER JOIN [dbo].[Lines] l ON l.OrderId = o.Id WHERE o.UserId = @UserId;
  INSERT INTO AuditLog (UserId, Action) VALUES (@UserId, 'SELECT x FROM y');
  UPDATE Users SET Seen = GETDATE() WHERE Id = @UserId
  DELETE FROM Cart WHERE UserId = @UserId
  MERGE INTO Stock AS t USING Orders AS s ON t.Id = s.Id WHEN MATCHED THEN UPDATE SET t.N = s.N;
  EXEC dbo.UpdateLastAccess @UserId
END
GO
""")
    p = "dbo.GetUserOrders"
    assert ("procedure", p) in s
    want = {("reads_from", p, "dbo.Orders"), ("joins", p, "dbo.Lines"), ("writes_to", p, "dbo.AuditLog"), ("writes_to", p, "dbo.Users"), ("writes_to", p, "dbo.Cart"), ("writes_to", p, "dbo.Stock"), ("calls", p, "dbo.UpdateLastAccess")}
    assert want <= r and not any("comment" in x[2] or x[2].endswith(".y") for x in r)


def test_tsql_view_lineage():
    s, r, c = facts("tsql", "CREATE VIEW dbo.ActiveUsers AS SELECT u.Id, u.Name, COUNT(r.Id) AS Roles, CASE WHEN u.Age > 3 THEN 1 ELSE 0 END Grown, u.A + u.B AS Both FROM dbo.Users u JOIN Roles AS r ON r.UserId = u.Id WHERE u.Active = 1 GROUP BY u.Id")
    v = "dbo.ActiveUsers"
    assert {("view", v), ("column", f"{v}.Id"), ("column", f"{v}.Name"), ("column", f"{v}.Roles")} <= s
    assert {("reads_from", v, "dbo.Users"), ("joins", v, "dbo.Roles")} <= r
    assert c == {("dbo.Users.Id", f"{v}.Id", "direct_copy"), ("dbo.Users.Name", f"{v}.Name", "direct_copy"), ("dbo.Roles.Id", f"{v}.Roles", "aggregate"), ("dbo.Users.Age", f"{v}.Grown", "conditional"), ("dbo.Users.A", f"{v}.Both", "transform")}


def test_tsql_trigger_and_templates():
    s, r, _ = facts("tsql", "CREATE TRIGGER dbo.trg ON dbo.Orders AFTER INSERT AS BEGIN INSERT INTO OrderHistory (Id) SELECT Id FROM inserted END\nGO\nCREATE TABLE {databaseOwner}[{objectQualifier}Portals] ([PortalID] [int] NOT NULL, [Name] nvarchar(20))\nGO\nCREATE PROC {databaseOwner}{objectQualifier}GetPortal @id int AS SELECT * FROM {databaseOwner}{objectQualifier}Portals\nGO")
    assert {("uses_table", "dbo.trg", "dbo.Orders"), ("writes_to", "dbo.trg", "dbo.OrderHistory"), ("reads_from", "dbo.GetPortal", "dbo.Portals")} <= r
    assert {("trigger", "dbo.trg"), ("table", "dbo.Portals"), ("column", "dbo.Portals.PortalID"), ("procedure", "dbo.GetPortal")} <= s


@pytest.mark.parametrize("head,context", [("CREATE PROC dbo.p AS ", "dbo.p"), ("", "dbo.T")])
def test_insert_select_by_position(head, context):
    _, _, c = facts("tsql", head + "INSERT INTO T (a, b, c) SELECT s.x, s.y, MAX(s.z) FROM Src s")
    assert c == {("dbo.Src.x", "dbo.T.a", "direct_copy"), ("dbo.Src.y", "dbo.T.b", "direct_copy"), ("dbo.Src.z", "dbo.T.c", "aggregate")}
    _, _, c = facts("tsql", head + "INSERT INTO T (a, b) SELECT x, y FROM Src")
    assert {x[0] for x in c} == {"dbo.Src.x", "dbo.Src.y"}


def test_update_lineage():
    _, _, c = facts("tsql", "CREATE PROC dbo.p AS UPDATE u SET u.Name = s.Title, Total = s.A * 2 FROM dbo.Users u JOIN dbo.Stage s ON s.Id = u.Id")
    assert c == {("dbo.Stage.Title", "dbo.Users.Name", "direct_copy"), ("dbo.Stage.A", "dbo.Users.Total", "transform")}


def test_postgres():
    s, r, c = facts("pgsql", """CREATE TABLE IF NOT EXISTS public.users (id serial PRIMARY KEY, name text NOT NULL, PRIMARY KEY (id));
CREATE OR REPLACE VIEW active_users AS SELECT id, upper(name) AS label FROM users WHERE true;
CREATE OR REPLACE FUNCTION public.get_user_orders(uid int) RETURNS TABLE(id int) LANGUAGE plpgsql AS $$ BEGIN SELECT o.id FROM orders o; PERFORM public.log_it(uid); END $$;
CREATE TRIGGER stamp BEFORE UPDATE ON users FOR EACH ROW EXECUTE FUNCTION update_timestamp();""")
    assert {("table", "public.users"), ("view", "active_users"), ("function", "public.get_user_orders"), ("trigger", "stamp"), ("column", "public.users.name")} <= s
    assert {("reads_from", "active_users", "users"), ("reads_from", "public.get_user_orders", "orders"), ("calls", "public.get_user_orders", "public.log_it"), ("uses_table", "stamp", "users"), ("calls", "stamp", "update_timestamp")} <= r
    assert ("users.name", "active_users.label", "transform") in c


def test_csharp():
    s, r, _ = facts("csharp", """using System.Data;
namespace MyApp.Models {
  [Table("Users")]
  public class User : BaseEntity, IIdentifiable {
    public DbSet<Order> Orders { get; set; }
    public virtual Address Home { get; set; }
    public void Load(int id) {
      var a = db.Users.FromSqlRaw("SELECT * FROM Users WHERE Id = 1");  // FROM nothing
      conn.Query<User>("GetUser", new { id }); conn.Execute("[dbo].[SaveUser]", id);
      q.Include(u => u.Roles);
    }
  }
}""")
    u = "MyApp.Models.User"
    assert {("class", u), ("method", f"{u}.Load"), ("property", f"{u}.Orders"), ("module", "MyApp.Models")} <= s
    assert {("imports", "", "System.Data"), ("inherits", u, "BaseEntity"), ("implements", u, "IIdentifiable"), ("uses_table", u, "Users"), ("uses_table", u, "Order"), ("uses_table", f"{u}.Load", "dbo.Users"),
            ("calls", f"{u}.Load", "dbo.GetUser"), ("calls", f"{u}.Load", "dbo.SaveUser"), ("references", f"{u}.Load", "Roles"), ("references", u, "Address")} <= r


def test_java():
    s, r, _ = facts("java", """package com.acme;
import java.util.List;
@Entity
@NamedQuery(name = "x", query = "SELECT u FROM Users u")
@Table(name = "people")
public class Person extends Base implements Named, Other {
  private String name;
  public List<String> load(Connection c) { PreparedStatement p = c.prepareStatement("SELECT * FROM users"); c.prepareCall("{call GetUser(?)}"); c.prepareCall("EXEC GetOne"); return null; }
}
interface Repo extends JpaRepository<User, Long> {
  @Query("SELECT u FROM Users u") List<User> all();
  List<User> findByName(String n); long countByAge(int a);
}""")
    p = "com.acme.Person"
    assert {("package", "com.acme"), ("class", p), ("method", f"{p}.load"), ("field", f"{p}.name"), ("interface", "com.acme.Repo")} <= s
    assert {("imports", "com.acme", "java.util.List"), ("inherits", p, "Base"), ("implements", p, "Named"), ("uses_table", p, "people"), ("uses_table", p, "Users"), ("uses_table", f"{p}.load", "dbo.users"), ("calls", f"{p}.load", "dbo.GetOne"),
            ("uses_table", "com.acme.Repo", "User")} <= r
    assert sum(x["to_name"] == "User" for x in parse_text("R.java", "java", "interface R extends CrudRepository<User, Long> { User findByA(int a); User findByB(int b); }").refs) == 3


def test_java_mappings():
    s, r, _ = facts("java", """package p;
@RestController
@RequestMapping("/orders/{id}")
public class Orders {
  @Resource private Store store;
  @GetMapping(produces = TEXT, value = {"/a;b", "/c"})
  // @PutMapping("/not")
  public String all(@RequestParam("x") int x) { call("@PostMapping(\\"/nor\\")"); return null; }
  @DeleteMapping
  public void none() { }
  @PostMapping(
      path = "/new"
  )
  String make(String s) { return s; }
}""")
    assert ("method", "p.Orders.all") in s
    assert {x for x in r if x[0] == "references"} == {("references", "p.Orders", "/orders/{id}"), ("references", "p.Orders.all", "/a;b"), ("references", "p.Orders.make", "/new")}


def test_javascript():
    s, r, _ = facts("typescript", """import { a } from 'lib'; const fs = require("fs");
@Entity('users') export class User extends Base implements Named { save(x: number): void { pool.query("SELECT * FROM customers"); } }
export interface Shape extends Base { a: number } enum Color { Red } type Id = string;
const load = async (id) => { await prisma.user.findMany(); knex('orders').select(); knex.raw("SELECT * FROM payments"); connection.execute(`INSERT INTO orders VALUES (1)`); fetch("https://x.y/select") };
const M = sequelize.define('accounts', {}); export default function main(a) { return 1; }""", "a/mod.ts")
    assert {("class", "mod.User"), ("interface", "mod.Shape"), ("enum", "mod.Color"), ("type", "mod.Id"), ("function", "mod.load"), ("function", "mod.main"), ("method", "mod.User.save")} <= s
    assert {("imports", "mod", "lib"), ("imports", "mod", "fs"), ("inherits", "mod.User", "Base"), ("implements", "mod.User", "Named"), ("uses_table", "mod.User", "users"), ("uses_table", "mod.User.save", "customers"),
            ("uses_table", "mod.load", "user"), ("uses_table", "mod.load", "orders"), ("uses_table", "mod.load", "payments"), ("writes_to", "mod.load", "orders"), ("uses_table", "mod", "accounts")} <= r


def test_asp():
    s, r, _ = facts("asp", """<%@ Page Language="C#" Inherits="Web.Default" CodeBehind="d.cs" %><%@ Import Namespace="System.Data" %><%@ Register Src="~/u.ascx" %>
<!-- #include file="top.inc" -->
<%
Const Max = 3
Function GetUser(id) ' SELECT x FROM commented
  sql = "SELECT * " & _
        "FROM Users"
  Set rs = conn.Execute("SELECT * FROM Orders")
End Function
Sub Save()
  Set c = Server.CreateObject("ADODB.Command")
End Sub
%>""", "d.asp")
    assert {("function", "GetUser"), ("procedure", "Save"), ("constant", "Max")} <= s
    assert {("imports", "d.asp", "top.inc"), ("imports", "d.asp", "System.Data"), ("inherits", "d.asp", "Web.Default"), ("imports", "d.asp", "~/u.ascx"), ("uses_table", "GetUser", "dbo.Users"), ("uses_table", "GetUser", "dbo.Orders"), ("references", "Save", "ADODB.Command")} <= r
    assert not any("commented" in x[2] for x in r)


def test_delphi():
    s, r, _ = facts("delphi", """unit MyUnit;
interface
uses SysUtils, Classes;
type
  TMyClass = class(TBase, IThing)
    property Name: string read FName;
    procedure Load;
  end;
implementation
{$I defs.inc}
procedure TMyClass.Load;
begin
  Query.SQL.Text := 'SELECT * ' + 'FROM Customers';
  Q.SQL.Add('SELECT Id'); Q.SQL.Add('FROM Orders');
end;
end.""")
    assert {("module", "MyUnit"), ("class", "MyUnit.TMyClass"), ("property", "MyUnit.TMyClass.Name"), ("method", "MyUnit.TMyClass.Load")} <= s
    assert {("inherits", "MyUnit.TMyClass", "TBase"), ("implements", "MyUnit.TMyClass", "IThing"), ("imports", "MyUnit", "SysUtils"), ("imports", "MyUnit", "defs.inc"), ("uses_table", "MyUnit.TMyClass.Load", "dbo.Customers"), ("uses_table", "MyUnit.TMyClass.Load", "dbo.Orders")} <= r
    s, r, _ = facts("dfm", "object Form1: TForm1\n  object Q: TQuery\n    SQL.Strings = (\n      'SELECT *'\n      'FROM Customers')\n  end\nend")
    assert ("variable", "TForm1.Q") in s and ("uses_table", "TForm1", "dbo.Customers") in r


def test_files_to_edges(spark):
    from graphloom.operators.resolution import column_edges, intra_file_edges, resolve_references

    rows = [("a.sql", "tsql", "CREATE TABLE dbo.T (a INT, b INT)\nGO\nCREATE VIEW dbo.V AS SELECT t.a, t.b + 1 AS c FROM dbo.T t\nGO", False), ("b.cs", "csharp", 'class Repo { public void Get() { c.Query("SELECT * FROM T"); } }', False),
            ("c.sql", "tsql", "CREATE VIEW dbo.W AS SELECT a FROM dbo.T", True), ("bad.bin", "none", "x", False)]
    parsed = parse_files(spark.createDataFrame(rows, "path string, language string, content string, skip_column_lineage boolean"))
    symbols, refs = symbols_of(parsed), references_of(parsed)
    name = {r.id: r.qualified_name for r in symbols.collect()}
    edges = {(name[e.src], name[e.tgt], e.edge_type, e.match_strategy) for e in resolve_references(refs, symbols).collect()}
    assert {("dbo.V", "dbo.T", "reads_from", None), ("dbo.W", "dbo.T", "reads_from", None), ("Repo.Get", "dbo.T", "uses_table", None)} <= edges
    assert {(name[e.src], name[e.tgt]) for e in intra_file_edges(refs, symbols).collect()} == {("dbo.V", "dbo.T")}
    found = {(name[e.src], name[e.tgt], e.edge_type) for e in column_edges(columns_of(parsed), symbols).collect()}
    assert found == {("dbo.T.a", "dbo.V.a", "direct_copy"), ("dbo.T.b", "dbo.V.c", "transforms_to")}


def test_long_annotation_blocks():
    queries = ", ".join(f'@NamedQuery(name = "q{i}", query = "SELECT a FROM T{i} a WHERE a.b = :x; }}")' for i in range(12))
    src = 'package p;\nclass Other { }\n@Entity\n@Table(name = "orders")\n@NamedQueries({' + queries + "})\npublic class Order { }\n"
    refs = facts("java", src)[1]
    assert ("uses_table", "p.Order", "orders") in refs and {f"T{i}" for i in range(12)} <= {name.split(".")[-1] for _, source, name in refs if source == "p.Order"}
    src = 'class A { }\n[Table("orders")]\n[Note("' + "x; }" * 120 + '")]\npublic class Order { }\n'
    assert ("uses_table", "Order", "orders") in facts("csharp", src)[1]
