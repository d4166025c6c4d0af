"""Tiny archives, stated byte by byte, and what changed bytes make of them: input of queries and tests, not of packing."""

from __future__ import annotations

# Whole archives in hex, two entries each (the texture archive has one).
BASES = {
    "tes3": "00010000300000000200000002000000000000000300000002000000000000000d0000006d65736865735c612e6e6966006d6973635c622e747874000816"
    "73683271b7543169736387cfe6424142434445",
    "bsa": "425341006800000024000000030000000100000002000000070000000c000000000000007365066d9a3a2f320200000040000000076d65736865730061"
    "800161fd45cd92020000006800000062000162c2a6d095030000006a000000612e6e696600622e747874004142434445",
    "sse": "425341006900000024000000030000000100000002000000070000000c000000000000007365066d9a3a2f3202000000000000004800000000000000076d"
    "65736865730061800161fd45cd92020000007000000062000162c2a6d0950300000072000000612e6e696600622e747874004142434445",
    "gnrl": "4254445801000000474e524c020000006500000000000000ce51b53a6e69660037ce700b00011000600000000000000000000000020000000df0adba7400"
    "bca37478740037ce700b00011000620000000000000000000000030000000df0adba41424344450c006d65736865735c612e6e69660c006d65736865735c62"
    "2e747874",
    "dx10": "425444580100000044583130010000005800000000000000ce51b53a646473007f66a5c00001180004000400024700004800000000000000100000001000"
    "0000000001000df0adba313233343536373861626364656667680e0074657874757265735c612e646473",
    "sf3": "4254445803000000474e524c020000007100000000000000010000000000000003000000ce51b53a6e69660037ce700b000110006c00000000000000000000"
    "00020000000df0adba7400bca37478740037ce700b000110006e0000000000000000000000030000000df0adba41424344450c006d65736865735c612e6e69"
    "660c006d65736865735c622e747874",
}
#: Case: base, changes (place, bytes in hex), bytes added at the end (negative: taken away), and the ids it is met with.
CASES = {
    "tes3_sound": ("tes3", (), 0, ""),
    "tes3_name_offset": ("tes3", ((32, "0e"),), 0, "tes3.name-offset-inconsistency"),
    "tes3_name_offset_beyond": ("tes3", ((28, "ff"),), 0, "tes3.invalid-name-offset"),
    "tes3_stored_hash": ("tes3", ((60, "ff"),), 0, "tes3.stored-hash-mismatch"),
    "tes3_trailing": ("tes3", (), 1, "tes3.trailing-data"),
    "tes3_cut": ("tes3", (), -1, "io.span-out-of-range"),
    "tes3_count": ("tes3", ((8, "ffffffff"),), 0, "io.span-out-of-range"),
    "tes3_overlap": ("tes3", ((24, "01"),), 0, "tes3.overlapping-payloads"),
    "tes3_shared": ("tes3", ((20, "02"), (24, "00")), -3, ""),
    "tes3_unterminated": ("tes3", ((59, "78"),), 0, "tes3.unterminated-name"),
    "tes3_undecodable": ("tes3", ((42, "81"),), 0, "archive-name.undecodable-wire-bytes"),
    "tes3_root": ("tes3", ((36, "73706c617368"),), 0, "tes3.stored-hash-mismatch,tes3.unsupported-asset-root"),
    "tes3_absolute": ("tes3", ((36, "5c"),), 0, "archive-name.absolute-path"),
    "tes3_traversal": ("tes3", ((36, "2e2e5c"),), 0, "archive-name.traversal-segment"),
    "tes3_device": ("tes3", ((43, "636f6e2e66"),), 0, "archive-name.windows-invalid-segment,tes3.stored-hash-mismatch"),
    "bsa_sound": ("bsa", (), 0, ""),
    "bsa_sections": ("bsa", ((12, "02"),), 0, "bsa.invalid-name-sections"),
    "bsa_folder_record": ("bsa", ((44, "03"),), 0, "bsa.invalid-folder-record"),
    "bsa_folder_hash": ("bsa", ((36, "ff"),), 0, "bsa.folder-hash-mismatch"),
    "bsa_file_hash": ("bsa", ((60, "ff"),), 0, "bsa.file-hash-mismatch"),
    "bsa_folder_empty": ("bsa", ((52, "00"),), 0, "bsa.invalid-folder-name"),
    "bsa_folder_unterminated": ("bsa", ((59, "41"),), 0, "bsa.unterminated-folder-name"),
    "bsa_folder_nul": ("bsa", ((55, "00"),), 0, "bsa.invalid-folder-name"),
    "bsa_base_unterminated": ("bsa", ((103, "41"),), 0, "bsa.unterminated-basename"),
    "bsa_in_index": ("bsa", ((72, "10"),), 0, "bsa.payload-overlaps-index"),
    "bsa_span": ("bsa", ((68, "ff"),), 0, "io.span-out-of-range"),
    "bsa_overlap": ("bsa", ((88, "69"),), 0, "bsa.overlapping-payloads"),
    "bsa_framing": ("bsa", ((71, "40"),), 0, "bsa.invalid-compressed-framing"),
    "bsa_duplicate": ("bsa", ((98, "412e6e6966"),), 0, "bsa.duplicate-name"),
    "bsa_embedded_span": ("bsa", ((13, "01"),), 0, "io.span-out-of-range"),
    "bsa_embedded_empty": ("bsa", ((13, "01"), (68, "00")), 0, "bsa.invalid-embedded-name-framing"),
    "bsa_version": ("bsa", ((4, "66"),), 0, "archive.unsupported-encoding"),
    "bsa_trailing": ("bsa", (), 3, ""),
    "sse_sound": ("sse", (), 0, ""),
    "sse_padding": ("sse", ((48, "01"), (56, "01")), 0, "bsa.nonzero-folder-padding,bsa.nonzero-folder-padding"),
    "gnrl_sound": ("gnrl", (), 0, ""),
    "gnrl_mod": ("gnrl", ((36, "01"),), 0, "gnrl.nonzero-mod-index"),
    "gnrl_chunks": ("gnrl", ((37, "02"),), 0, "gnrl.invalid-chunk-count"),
    "gnrl_width": ("gnrl", ((38, "11"),), 0, "gnrl.chunk-header-size"),
    "gnrl_sentinel": ("gnrl", ((56, "00"),), 0, "gnrl.sentinel-mismatch"),
    "gnrl_base_hash": ("gnrl", ((24, "ff"),), 0, "ba2.basename-hash-mismatch"),
    "gnrl_extension": ("gnrl", ((28, "ff"),), 0, "ba2.extension-mismatch"),
    "gnrl_folder_hash": ("gnrl", ((32, "ff"),), 0, "ba2.directory-hash-mismatch"),
    "gnrl_no_names": ("gnrl", ((16, "00"),), 0, "ba2.missing-name-table,ba2.trailing-data"),
    "gnrl_names_in_index": ("gnrl", ((16, "20"),), 0, "ba2.names-overlap-index"),
    "gnrl_in_index": ("gnrl", ((40, "20"),), 0, "ba2.payload-overlaps-index"),
    "gnrl_in_names": ("gnrl", ((40, "66"),), 0, "ba2.payload-overlaps-names"),
    "gnrl_overlap": ("gnrl", ((76, "61"),), 0, "ba2.overlapping-payloads"),
    "gnrl_span": ("gnrl", ((52, "ff"),), 0, "io.span-out-of-range"),
    "gnrl_nul": ("gnrl", ((103, "00"),), 0, "ba2.nul-name"),
    "gnrl_duplicate": ("gnrl", ((117, "4d45534845535c412e4e4946"),), 0, "ba2.duplicate-name"),
    "gnrl_trailing": ("gnrl", (), 2, "ba2.trailing-data"),
    "gnrl_version": ("gnrl", ((4, "09"),), 0, "archive.unsupported-encoding"),
    "dx10_sound": ("dx10", (), 0, ""),
    "dx10_chunks": ("dx10", ((37, "05"),), 0, "dx10.invalid-chunk-count"),
    "dx10_mips": ("dx10", ((44, "04"),), 0, "dx10.invalid-mip-count"),
    "dx10_range": ("dx10", ((66, "00"),), 0, "dx10.invalid-mip-range"),
    "dx10_stored": ("dx10", ((56, "00"),), 0, "dx10.stored-chunk"),
    "dx10_sentinel": ("dx10", ((68, "00"),), 0, "dx10.sentinel-mismatch"),
    "dx10_format": ("dx10", ((45, "02"),), 0, "dds.unsupported-format"),
    "dx10_width": ("dx10", ((38, "10"),), 0, "dx10.chunk-header-size"),
    "dx10_mod": ("dx10", ((36, "01"),), 0, "dx10.nonzero-mod-index"),
    "sf3_sound": ("sf3", (), 0, ""),
    "sf3_extra": ("sf3", ((24, "02"),), 0, "ba2.extra-header-value"),
    "sf3_method": ("sf3", ((32, "00"),), 0, "archive.unsupported-encoding"),
}
#: What the compatibility profile makes of some cases.
LENIENT = {"sf3_method": "ba2.sf3-zlib-fallback", "tes3_sound": "", "gnrl_version": "archive.unsupported-encoding"}


def vector(case: str) -> bytes:
    base, changes, added, _ = CASES[case]
    data = bytearray.fromhex(BASES[base])
    for at, own in changes:
        data[at : at + len(own) // 2] = bytes.fromhex(own)
    return bytes(data) + bytes(added) if added >= 0 else bytes(data[:added])
