"""A report as one HTML page without anything to load; all data in it is escaped."""

from __future__ import annotations

import datetime as dt
import html
import json

from netquarry.operators import devices, findings, reports
from netquarry.plans.scan import Inventory
from netquarry.sinks.files import rows
from netquarry.sinks.text import identity, services

STYLE = """body{font:14px sans-serif;margin:2em;max-width:75em}table{border-collapse:collapse;width:100%}td,th{text-align:left;padding:.3em .6em;border-bottom:1px solid #ddd;vertical-align:top}
.CRITICAL{color:#a00}.HIGH{color:#c40}.MEDIUM{color:#a70}svg{vertical-align:middle}#bars{display:flex;align-items:flex-end;height:54px;touch-action:none}#bars span{flex:1;display:flex;align-items:flex-end;height:100%;margin-right:1px;cursor:crosshair}
#bars i{width:100%;background:#9ab}#bars .in i{background:#247}#panels{display:flex;flex-wrap:wrap;gap:2em}#panels ul{list-style:none;padding:0;margin:0;min-width:14em}#panels li{background:linear-gradient(#cde,#cde) no-repeat 0/var(--part) 100%;padding:.1em .3em}#panels b{float:right;margin-left:1em}"""
#: A glyph for each class of device; one that isn't here looks unknown.
ICONS = {
    "camera": "\U0001f4f7", "iot": "\U0001f4e1", "mobile": "\U0001f4f1", "nas": "\U0001f4be", "network": "\U0001f500", "phone": "\U0001f4de",
    "plc": "\U0001f3ed", "printer": "\U0001f5a8", "server": "\U0001f5a5", "unknown": "\u2753", "vm": "\U0001f9ca", "workstation": "\U0001f4bb",
}
#: What the panels say of a range of bars ([first, last], or null for all of them) and a text: everything but the findings' text filter follows from the devices shown.
PANELS = """
const total=digits=>[...digits].reduce((n,c)=>n+Number(c),0);
function tally(lists){const n=new Map();for(const x of lists.flat())n.set(x,(n.get(x)||0)+1);return n}
const leading=(counts,most)=>[...counts].sort((a,b)=>b[1]-a[1]||(a[0]<b[0]?-1:1)).slice(0,most);
function panels(data,range,text){
const part=d=>range?d.digits.slice(range[0],range[1]+1):d.digits;
const shown=data.devices.filter(d=>(!range||total(part(d))>0)&&d.words.includes(text.toLowerCase()));
const here=new Set(["sensor",...shown.map(d=>d.ip)]);
const [found,held]=[true,false].map(want=>data.findings.filter(f=>(!range||here.has(f.device))===want));
const volume=d=>total(part(d))===total(d.digits)?d.events:Math.floor(d.events*total(part(d))/total(d.digits)+0.5);
const users=tally(shown.map(d=>d.users)),critical=list=>list.filter(f=>f.severity==="CRITICAL").length;
return {shown:shown.map(d=>d.ip),devices:shown.length,identified:shown.filter(d=>d.known).length,named:shown.filter(d=>d.named).length,
classes:leading(tally(shown.map(d=>[d.kind])),Infinity),protocols:leading(tally(shown.map(d=>d.protocols)),6),users:leading(users,6),accounts:users.size,
talkers:shown.map(d=>[d.ip,volume(d)]).filter(t=>t[1]>0).sort((a,b)=>b[1]-a[1]).slice(0,6),
severities:["CRITICAL","HIGH","MEDIUM","LOW"].map(s=>[s,shown.filter(d=>d.worst===s).length]).filter(s=>s[1]),
findings:found.length,critical:critical(found),held:held.length,heldCritical:critical(held),kept:found.map(f=>f.place)}}
"""
#: Draws the panels, takes ranges from the list or by dragging over the bars, and loads the page anew when its file has changed and nobody is reading.
SCRIPT = """
const at=id=>document.getElementById(id),bars=[...at("bars").children],rows=[...document.querySelectorAll("#devices tbody tr")],found=[...document.querySelectorAll("#findings tbody tr")];
let range=null,chosen=false;
const hue=name=>[...name].reduce((h,c)=>(h*31+c.codePointAt(0))%360,7);
function list(id,items,none){const most=Math.max(...items.map(i=>i[1]),1);at(id).replaceChildren(...(items.length?items:[[none,""]]).map(([name,n])=>{const li=document.createElement("li"),b=document.createElement("b");
b.textContent=n===""?n:n.toLocaleString();li.append(b,name);li.style.setProperty("--part",n===""?"0":100*n/most+"%");return li}))}
function ring(classes,all){let past=0;at("ring").replaceChildren(...classes.map(([name,n])=>{const c=document.createElementNS("http://www.w3.org/2000/svg","circle");
for(const [k,v] of Object.entries({cx:20,cy:20,r:15,fill:"none","stroke-width":8,pathLength:100,stroke:`hsl(${hue(name)} 50% 55%)`,"stroke-dasharray":`${100*n/all} 100`,"stroke-dashoffset":-past}))c.setAttribute(k,v);past+=100*n/all;return c}))}
function draw(){const p=panels(DATA,range,at("text").value.trim()),shown=new Set(p.shown),kept=new Set(p.kept);
for(const r of rows)r.hidden=!shown.has(r.dataset.ip);
found.forEach((r,k)=>{r.hidden=!kept.has(k)});
bars.forEach((b,k)=>b.classList.toggle("in",!!range&&k>=range[0]&&k<=range[1]));
for(const k of ["devices","identified","named","findings","critical","accounts"])at("n-"+k).textContent=p[k].toLocaleString();
at("held").hidden=!p.held;at("n-held").textContent=p.held+(p.heldCritical?` (${p.heldCritical} critical)`:"");
at("when").textContent=range?bars[range[0]].title.split(": ")[0]+" and "+(range[1]-range[0])*DATA.step+" h more":"the whole capture";
ring(p.classes,p.devices);list("classes",p.classes,"no device in this range");list("talkers",p.talkers,"nobody");list("protocols",p.protocols,"none");list("users",p.users,"nobody");list("severities",p.severities,"nothing found on these devices")}
function last(hours){range=hours?[Math.max(0,bars.length-Math.ceil(hours/DATA.step)),bars.length-1]:null;draw()}
at("text").oninput=draw;at("range").onchange=()=>{chosen=true;last(+at("range").value)};at("all").onclick=()=>{chosen=true;at("range").value="0";last(0)};
let from=-1;
bars.forEach((b,k)=>{b.onpointerdown=e=>{e.preventDefault();from=k;range=[k,k];draw()};b.onpointerenter=()=>{if(from>=0){range=[Math.min(from,k),Math.max(from,k)];draw()}}});
addEventListener("pointerup",()=>{if(from>=0){from=-1;at("range").value="0";if(range[0]===range[1])range=null;chosen=!!range;draw()}});
if(DATA.refresh&&location.protocol.startsWith("http")){let known=null;const busy=()=>at("text").value||chosen||from>=0||document.querySelector("details[open]");
setInterval(async()=>{try{const r=await fetch(location.href,{method:"HEAD",cache:"no-store"}),mark=r.ok&&(r.headers.get("etag")||r.headers.get("last-modified"));
if(mark&&known&&mark!==known){if(busy())at("newer").hidden=false;else location.reload()}known=known||mark}catch(e){}},DATA.refresh*1000)}
last(+at("range").value);
"""


def embedded(value) -> str:
    """JSON that can stand in a script: no text in it ends the script."""
    return json.dumps(value, ensure_ascii=False).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def panel_data(shown: list[dict], reported: list[dict], digits: dict[str, str], step: int = 1, refresh: int = 0) -> dict:
    """What the page's script works on: of each device what it counts by, of each finding its device and severity."""

    def device(d: dict) -> dict:
        known = any(d[c] for c in ("class", "vendor", "os", "model"))
        words = [*(d[c] for c in reports.SEARCHED), *d["ot_identifiers"], *d["users"]]
        return {
            "ip": d["ip"], "kind": (d["class"] or "other") if known else "unknown", "known": known, "named": bool(d["hostname"]), "worst": d["worst"], "words": " ".join(w for w in words if w).lower(),
            "protocols": d["protocols"], "users": d["users"], "events": sum(d["activity"].values()), "digits": digits.get(d["ip"], ""),
        }

    return {"step": step, "refresh": refresh, "devices": [device(d) for d in shown], "findings": [{"place": k, "device": f["device"], "severity": f["severity"]} for k, f in enumerate(reported)]}


def page(found: Inventory, title: str = "Network inventory", refresh: int = 0) -> str:
    """The whole report; with ``refresh``, a page that asks its server so many seconds apart whether there is a newer one."""
    e = lambda x: html.escape(str(x))
    activity = devices.activity(found.folded)
    scale = reports.scale(found.extent).first()
    digits = {r["ip"]: r["buckets"] for r in rows(reports.bucket_strings(activity, found.extent))} if scale else {}
    sparks = {r["ip"]: r["spark"] for r in rows(reports.sparklines(activity, found.extent))} if scale else {}
    bars = rows(reports.timeline(activity, found.extent).orderBy("bar")) if scale else []
    shown = rows(devices.ordered(reports.worst_marked(found.devices, findings.worst(found.findings))))
    reported = rows(findings.ordered(found.findings))
    hours = (scale["high"] - scale["low"] + 1) if scale else 0
    first = 24 if hours > 24 else 0
    out = [f"<!doctype html><html lang=en><meta charset=utf-8><title>{e(title)}</title><style>{STYLE}</style>"]
    out.append(f"<h1>{e(title)}</h1><p id=newer hidden><a href=''>There is a newer report.</a></p>")
    out.append("<p>" + ", ".join(f"<span id=n-{k}></span> {k}" for k in ("devices", "identified", "named", "findings", "critical", "accounts")) + " in <span id=when></span></p>")
    hour = lambda h: f"{dt.datetime.fromtimestamp(h * 3600, dt.UTC):%Y-%m-%d %H:%M}"
    out.append("<div id=bars>" + "".join(f"<span title='{hour(b['hour'])}: {b['n']:,}'><i style='height:{b['height']:.0f}%'></i></span>" for b in bars) + "</div>")
    choices = "".join(f"<option value={p['hours']}{'' if p['offered'] else ' disabled'}{' selected' if p['hours'] == first else ''}>last {p['hours']} h</option>" for p in rows(reports.presets(found.extent)))
    out.append(f"<p><input id=text placeholder=search> <select id=range><option value=0>all</option>{choices}</select></p>")
    lists = (("classes", "Classes"), ("severities", "Worst findings"), ("talkers", "Busiest (events)"), ("protocols", "Protocols (devices)"), ("users", "Accounts (devices)"))
    out.append("<div id=panels><svg id=ring width=120 height=120 viewBox='0 0 40 40'></svg>" + "".join(f"<div><h3>{name}</h3><ul id={k}></ul></div>" for k, name in lists) + "</div>")
    out.append("<h2>Devices</h2><table id=devices><thead><tr><th>Address<th>Name<th>What<th>Confidence<th>Services<th>Activity<th>Evidence<tbody>")
    for d in shown:
        proof = "<br>".join(f"{e(x['conclusion'])} {x['weight']:.2f}: {e(x['signal'])} {e(x['value'][:120])}" for x in d["evidence"])
        spark = f"<svg width=100 height=20><polyline points='{e(sparks[d['ip']])}' fill=none stroke='#47a'/></svg>" if d["ip"] in sparks else ""
        icon = ICONS.get(d["class"], ICONS["unknown"])
        out.append(f"<tr data-ip='{e(d['ip'])}' class='{e(d['worst'])}'><td>{e(d['ip'])}<td>{e(d['hostname'])}<td><span aria-hidden=true>{icon}</span> {e(identity(d))}<td>{d['confidence']:.0%}<td>{e(services(d['services']))}<td>{spark}<td><details><summary>{len(d['evidence'])}</summary>{proof}</details>")
    out.append("</table><h2>Findings</h2><p id=held hidden><span id=n-held></span> more on devices that were silent in this range. <button id=all>Show all</button></p><table id=findings><thead><tr><th>Severity<th>Device<th>What<th>Advice<th>Times<tbody>")
    for f in reported:
        out.append(f"<tr data-device='{e(f['device'])}'><td class={e(f['severity'])}>{e(f['severity'])}<td>{e(f['device'])}<td>{e(f['title'])}<br>{e(f['detail'])}<td>{e(f['fix'])}<td>{f['count']:,}")
    out.append("</table><h2>Accounts</h2><table>" + "".join(f"<tr><td>{e(u['user'])}<td>{e(', '.join(u['devices']))}" for u in rows(devices.identities_ordered(found.identities))) + "</table>")
    out.append("<h2>Coverage</h2><table>" + "".join(f"<tr><td>{e(c['event_type'])}<td>{c['n']:,}" for c in rows(reports.coverage(found.event_counts).orderBy("place"))) + "</table>")
    data = panel_data(shown, reported, digits, scale["step"] if scale else 1, int(refresh))
    return "".join(out) + f"<script>const DATA={embedded(data)};{PANELS}{SCRIPT}</script></html>\n"
