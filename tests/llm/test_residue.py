"""Template residue: kinds, decoys, recurrence, edge cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("plumbline.llm")
from plumbline.llm import residue as R  # noqa: E402

CASES = {
    "{{room_name}}": "slot", "Use ${unit_price} off A-3, carry 10%": "slot", "{3} SF": "slot", "<%= area %>": "slot", "«unit price»": "slot", "<<Lead Time>>": "slot", "@@TRADE@@ x": "slot",
    "[INSERT room name]": "slot", "<your lead time>": "slot", "(to be entered)": "slot", "[HOLD FOR INPUT]": "slot", "[awaiting sub quote]": "slot", "____": "slot", "xx,xxx": "slot", "####": "slot", "Tbd - estimator": "slot",
    "T.B.D.": "slot", "Qty to be completed per A3": "slot", "lorem ipsum dolor": "filler", "Carry 5%. Nunc congue ipsum aliqua.": "filler", "asdf asdf": "filler", "Type notes here...": "filler", "dummy text dummy text": "filler",
    "This is a sample line, delete before issue": "filler", "404 Not Found": "error_page", "HTTP 503 : file or directory missing": "error_page", "Request 0c196637 timed out after 67 s": "error_page",
    "<html><head><title>403 Forbidden</title></head></html>": "error_page", "This link is no longer valid": "error_page", "Access denied. You do not have permission": "error_page", "Too many requests - slow down and retry": "error_page",
    "Please enable JavaScript to view this sheet": "scripts", "<noscript>Scripts are off</noscript>": "scripts", "YOU NEED TO TURN ON SCRIPTS IN YOUR BROWSER TO RUN THIS APP.": "scripts",
}
DECOYS = [
    "0", "1,250", "~375", "[375]", "(fill in cells with grout, 3 lifts, 45 CF)", "{375 LF} carried, low side of the range was 300", "Set {A} hinges where {B} leaf exceeds 36 in", "XXXX-heavy nipples at the lab riser, 4 each",
    "Pull tag marked xx-12 on conduit bank", "<enter by dock 5 only> gate code from the guard", "[HOLD 3 in clear at jamb, per RFI 4]", "[A3.1] base returns into 2 door recesses", "[Area: 375 SF, filled in from A3]",
    "TBD item closed 3/4: 375 LF confirmed on site", "Form says 'TBD by owner'; owner fixed it at 5 on 3/4", "Sleeve placeholder foam stays in slab until pipe 5 is set", "Access denied to crawlspace on the walk, so 5 SF comes from as-builts",
    "Error in bid form line 5 fixed by addendum 6", "Script lettering on donor wall, enabled for backlight, 5 characters", "Enable the script-controlled lights only after 5 pm", "Server room must be enabled before java bar cabinets go in (5 hrs)",
    "Room 5 not found on A3, counted from A4 instead", "Test lift forbidden during class, 5 evenings carried", "Sample panel Wexu approved; text height 5 in.", "Lippage <1/8 in; grout joint >3 mm", "Use the hinge template supplied by Vexu for bolt holes", "Work to be completed by March",
]


def frame(spark, texts):
    return R.field_rows(spark.createDataFrame([(i, "b", t, t) for i, t in enumerate(texts)], "id bigint, bid string, notes string, text string"), "t", "id", ["notes"], "bid")


def test_kinds_and_decoys(spark):
    texts = [*CASES, *DECOYS]
    found = {texts[r.row_id]: r.kind for r in R.residue(frame(spark, texts)).collect()}
    assert found == CASES


def test_recurrence_and_repeats(spark):
    weak = spark.createDataFrame([(i, f"b{i % 3}", "hum hum hum") for i in range(4)] + [(9, "b", "go go go"), (1, "b1", "hum hum hum")], "id bigint, bid string, notes string")
    out = R.residue(R.field_rows(weak, "t", "id", ["notes"], "bid"))
    assert sorted((r.row_id, r.n_rows) for r in out.collect()) == [(0, 5), (1, 5), (2, 5), (3, 5)]


def test_edges(spark):
    long = "fine words " * 20000
    out = R.residue(frame(spark, [None, "", "  ", long, long + "{{x}}"]))
    assert [(r.row_id, r.kind) for r in out.collect()] == [(4, "slot")]
    assert R.residue(frame(spark, ["a"]).where("false")).count() == 0
    df = spark.createDataFrame([(1, "a", "TBD"), (2, "a", "fine")], "id bigint, bid string, notes string")
    cleaned = R.clean(df, R.residue(R.field_rows(df, "t", "id", ["notes"], "bid")), "t", "id", "notes")
    assert {r.id: r.notes for r in cleaned.orderBy("id").collect()} == {1: None, 2: "fine"}
    assert R.message_form(F.lit("x")) is not None


KNOWN_RESIDUE = (  # these and KNOWN_REAL were in view while the rules were written, twelve of them came out of a review: no held-out measure
    "[Project name]", "{name}", "<INSERT>", "Your browser does not support JavaScript", "The requested URL was not found on this server.", "Oops! Something went wrong", "Page not available",
    "{client.address}", "[Contact phone]", "<Vendor name>", "{{ rate | default }}", "This page has moved.", "The server is currently unavailable", "503 Service Unavailable", "Access denied", "An error occurred, try again later",
    "Please enable JavaScript in your browser", "Lorem ipsum dolor sit amet", "Error 404", "HTTP status 500", "We're sorry, something went wrong", "site can't be reached", "[enter date]", "${project.county}",
)
KNOWN_REAL = (
    "Room 214 not found during survey", "Panel 3 gone, replace in kind", "Freight elevator temporarily unavailable until June", "Visitors sign in again after lunch", "This site is not level at the north end",
    "Room 404 not found on the plan", "Panel 503 service unavailable during shutdown", "Owner denied access to the roof", "Sample of stone approved by architect", "Crew signs in at gate 4", "Enter from the dock side only",
    "Roof drain not found at grid C", "Elevator under repair, use stair 2", "Insert plates by others", "Contractor name painted on hoarding", "Page 12 of the specs governs", "See sheet A-404 for detail", "Type X board at shaft",
    "Connection to existing main by utility", "Request for substitution approved", "Access panel denied by inspector, relocated", "Server racks by owner", "Template for bolts by fabricator", "Time out of service: 4 hours",
    "[Room 12 only]", "Scripted signage letters, 4 in high", "Replace door closers, 404 in all", "Add 3 coats at 500 sf per gal", "Temporarily support beam before cutting", "Site unavailable to trucks before 7 am",
)


def test_known_phrases(spark):
    texts = [*KNOWN_RESIDUE, *KNOWN_REAL]
    found = {texts[r.row_id] for r in R.residue(frame(spark, texts)).collect()}
    hits = len(found & set(KNOWN_RESIDUE))
    assert hits >= 0.9 * len(KNOWN_RESIDUE) and hits >= 0.9 * len(found), (set(KNOWN_RESIDUE) - found, found & set(KNOWN_REAL))


# Written after the rules and run once against them as they stood: 10 of the 20 residues found, none of the 20 remarks. The rules
# were not changed for these; whoever changes them in view of these needs new ones.
FRESH_RESIDUE = (
    "%CLIENT_NAME%", "[Company Address Line 1]", "<<insert scope>>", "{{#if notes}}", "Click here to add text", "Heading text to be added", "[Date]", "Xxxxx Xxxxx", "HTTP 429 - rate limit exceeded", "Gateway Timeout", "This site can't provide a secure connection", "The webpage is not available", "Sorry, we couldn't find that page", "Internal Server Error", "Your connection was interrupted", "JavaScript must be enabled to continue", "This app requires JavaScript to run", "Turn on JavaScript and reload the page", "Placeholder text - do not publish", "Sed ut perspiciatis unde omnis iste natus error",
)
FRESH_REAL = (
    "Contractor to verify all dimensions in field", "Gate 2 closed, use gate 4", "Door 502 hardware missing", "Connection detail 5/S-401 typical", "Server closet needs dedicated cooling", "Script for opening ceremony by owner", "Sample room finish approved 5/12", "Bidder to enter via north lot", "Page 3 of addendum replaces page 3", "Service unavailable to crane after 6 pm", "Access restricted to badge holders", "Error in drawing corrected by RFI 12", "Not found in spec section 09 91 23", "Session with architect on Monday", "Placeholder beam by others, remove after pour", "Test and balance by others", "Date of pour to be confirmed by supplier", "Type A partition to deck", "Line 404 of the estimate was doubled", "Insert anchors at 24 in o.c.",
)


def test_fresh_phrases(spark):
    """Precision on phrases the rules were not written for; their recall was one half, short of the 0.9 wished for."""
    texts = [*FRESH_RESIDUE, *FRESH_REAL]
    found = {texts[r.row_id] for r in R.residue(frame(spark, texts)).collect()}
    hits = len(found & set(FRESH_RESIDUE))
    assert hits >= 10 and hits >= 0.9 * len(found), (set(FRESH_RESIDUE) - found, found & set(FRESH_REAL))


def test_a_weak_cue_needs_recurrence(spark):
    text = "the portal was currently unavailable to bidders"
    rows = [(i, f"b{i % 3}", text) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, bid string, notes string")
    assert R.residue(R.field_rows(df, "t", "id", ["notes"], "bid")).count() == 4
    assert R.residue(R.field_rows(df.where("id = 1"), "t", "id", ["notes"], "bid")).count() == 0
    remark = spark.createDataFrame([(i, f"b{i % 3}", "freight elevator temporarily unavailable until june") for i in range(9)], "id bigint, bid string, notes string")
    assert R.residue(R.field_rows(remark, "t", "id", ["notes"], "bid")).count() == 0
